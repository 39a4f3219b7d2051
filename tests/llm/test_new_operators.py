"""Operators 11 to 13 against brute force: nulls, repeats, ties, empty tables, clashing columns, long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rosterfold.llm import cover_tree, importance, merkle, ranks
from rosterfold.llm.common import pin
from tests.llm import cases

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, slot int, path string, weight int, rank int"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes: list[str]) -> tuple[list[list[tuple[str, str]]], str]:
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
            at[k] = i // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return paths, nodes[0]


def manifest(rows) -> Counter:
    groups: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = text.replace("\n", "") if even and text is not None else text
        leaves = [sha(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, other)]
        groups.setdefault(source, []).append((doc_id, *leaves))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        group = sorted(groups[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((group, *climb([x[1] for x in group])))
    above, root = climb([t[2] for t in trees]) if trees else ([], None)
    out: Counter = Counter()
    for (group, paths, subroot), upper in zip(trees, above, strict=True):
        for (doc_id, leaf, other), path in zip(group, paths, strict=True):
            whole = path + upper
            found = other
            for left, right in whole:
                found = sha(left, found, right)
            out[doc_id, leaf, subroot, root, sha(*[a + b for a, b in whole]), found, found == root] += 1
    return out


def manifest_rows() -> list[tuple]:
    rnd = random.Random(5)
    rows = {}
    for _ in range(400):
        doc_id = rnd.randrange(-5000, 5000) * 10 ** rnd.choice([0, 0, 3, 14])
        rows[doc_id] = (doc_id, rnd.choice([None, "", "a\nb", "héé", "x\ny\nz"]), rnd.choice([None, "en"]), rnd.choice([None, "", "a", "b", "é", "Z"]), rnd.choice([None, 3]))
    rows = [*rows.values(), (2**63 - 1, "a", None, None, 0), (-(2**63), "b\n" * 200_000, None, None, 0)]
    return rows


@pytest.mark.parametrize("name", ["mixed", "empty", "one", "hot", "repeats"])
def test_manifest_matches_brute_force(spark, name):
    mixed = manifest_rows()
    rows = {
        "mixed": mixed,
        "empty": [],
        "one": [(1, "a\n", "en", "s", 2)],
        "hot": [(k, f"t\n{k}", "en", "hot" if k % 3 else f"s{k % 7}", k) for k in range(2500)],
        "repeats": mixed + mixed[:50] + [(None, f"q\n{k % 40}", None, "a", k % 3) for k in range(900)] + [(7, "same\n", None, "a", 1)] * 5000,
    }[name]
    docs = spark.createDataFrame([(*r, "x", 3, "p", 4, None) for r in rows], SCHEMA).repartition(3)
    found = merkle.digest(merkle.manifest(docs, {"text": merkle.without_line_feeds(docs)}))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in found.select(columns).collect()) == manifest(rows)


def test_manifest_places_are_gapless_and_its_plan_sorts_no_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)  # a directory of many steps
    rows = [(k * 977, "t", "en", "s", k) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = merkle.manifest(docs).select("doc_id", "position").collect()
    assert sorted((r.position, r.doc_id) for r in found) == [(k, k * 977) for k in range(1500)]


def test_ranks_follow_the_whole_order(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, 1, 2, 2, 2, 5])) for k in range(3000)]
    df = pin(spark.createDataFrame(rows, "a int, b int").repartition(5))
    got = ranks.ranked(df, [df.b.desc_nulls_last(), df.a.asc()], "place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted((r.place, r.a) for r in got) == [(k + 1, a) for k, (a, _) in enumerate(want)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text: str | None) -> tuple[list[str], int]:
    words = WORD.findall(cases.lower(text or ""))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def resampled(docs, target, buckets: int = 10_000) -> Counter:
    found = [(doc_id, [zlib.crc32(f.encode()) % buckets for f in runs(text)[0]], runs(text)[1]) for doc_id, text in docs]
    s = Counter(b for _, own, _ in found for b in own)
    t = Counter(zlib.crc32(f.encode()) % buckets for text in target for f in runs(text)[0])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000.0 * math.log(((t[b] + 1.0) * (all_s + 10000.0)) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in range(buckets)]
    rows = []
    for doc_id, own, n_words in found:
        h = int(sha(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n_words])
    long = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(long[: len(long) * 5 // 100]):
        row[4] = k + 1
    return Counter(map(tuple, rows))


def test_position_table_gives_crc32_of_every_span():
    rnd = random.Random(3)
    data = rnd.randbytes(60_000)
    spans = [(a, a + rnd.choice([1, 2, 63, 64, 65, 127, 128, 129, 500, 1023, 1030, 9000])) for a in (rnd.randrange(50_000) for _ in range(2000))]
    spans += [(0, len(data))]
    starts, ends = np.array(spans).T
    assert importance.span_crcs(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert len(importance.span_crcs(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("limit", [5, 40, 333])
def test_features_of_pieces_are_those_of_the_text(limit):
    rnd = random.Random(4)
    words = ["The", "é", "x" * 70, "a1", "日本", "of"]
    text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", ",\n", "."]) for _ in range(500)).encode()
    for whole in (text, b"", b"...", b"y" * 1000, b" a b"):
        counts = []
        for pieces in ([(whole, 0)], list(importance._pieces(whole, limit))):
            found = [importance.features([p], 1000) for p in pieces]
            counts.append((Counter(b for f, _ in found for _, own in f for b in own.tolist()), sum(int(w.sum()) for _, w in found)))
        assert counts[0] == counts[1]


def test_resampling_matches_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(50)] + ["Énorme", "日本", "A-B", "z" * 90]
    texts = [None, "", " \n", "one", "ten " * 19, "ten " * 20, "word " * 300_000]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[20]), (None, texts[21])] + [(5, texts[30])] * 40  # ties and repeats
    target = [None, "", " ".join(vocabulary), "w1 w2 w3 w4"]
    docs = spark.createDataFrame([(*r, None, None, "x", "y", "s", 1, 2, 3)[:2] + ("l", "s", 1, "k", 2, "p", 3, 4) for r in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = importance.resample(docs, bench).collect()
    assert Counter(tuple(r) for r in found) == resampled(rows, target)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(k, "a b c " * 10) for k in range(40)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).collect() == []
    found = importance.resample(docs, none).collect()
    assert Counter(tuple(r) for r in found) == resampled([(k, "a b c " * 10) for k in range(40)], [])


def linked(rows, threshold: float = 0.93) -> Counter:
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least: dict = {}
    for k, (vec_id, _, _) in enumerate(rows):
        known = [x for x in (least.get(root(k)), vec_id) if x is not None]
        least[root(k)] = min(known) if known else None
    return Counter((d, links[k], least[root(k)], d == least[root(k)]) for k, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)  # several cells and blocks
    monkeypatch.setattr(cover_tree, "GRID", 3)
    rng = np.random.default_rng(7)
    hubs = rng.normal(size=(12, 6))
    rows = []
    for k in range(400):
        v = hubs[k % 12] * rng.uniform(0.1, 9) if k % 3 else rng.normal(size=6)
        rows.append((k, [float(np.float32(x)) for x in v + rng.normal(size=6) * 0.12], k % 3 if k % 50 else None))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(60)]  # copies
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]), (None, rows[7][1], 0)]
    odd = [None, [], [0.0] * 6, [None] * 6, [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5, [1.0, 2.0], [2.0, 4.0], [1e-30] * 6, [3.0] * 6, [-1.0] * 6]
    rows += [(2000 + k, v, 1) for k, v in enumerate(odd)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, node int, size int").repartition(3)
    found = cover_tree.near_duplicates(vectors).collect()
    assert Counter(tuple(r) for r in found) == linked(rows)
    assert cover_tree.near_duplicates(vectors.limit(0)).collect() == []


def test_vectors_at_the_threshold():
    raw = np.array([[1.0, 0, 0], [0.93, math.sqrt(1 - 0.93**2), 0], [93.0, 0, math.sqrt(100**2 - 93**2)]])
    block = cover_tree.Block.of(raw, np.arange(3), np.ones(3, np.int64))
    want = [sum(cover_tree._exact(raw[i], raw[j], 0.93) for j in range(3) if i != j) for i in range(3)]
    assert cover_tree.Traversal(block, None, 0.93).counts[0].tolist() == [want[i] for i in block.nodes]


def test_cover_tree_holds_its_invariants():
    rng = np.random.default_rng(8)
    points = cover_tree.unit(np.repeat(rng.normal(size=(30, 5)), 10, axis=0) + rng.normal(size=(300, 5)) * 0.2)
    order, levels = cover_tree.build(points)
    points = points[order]
    for level, radius in zip(levels[1:-1], cover_tree.RADII, strict=False):
        for centre, far, s, e in zip(level.centres, level.radii, level.starts[:-1], level.starts[1:], strict=True):
            distance = np.sqrt(np.maximum(0, 2 - 2 * points[s:e] @ points[centre]))
            assert s <= centre < e and distance.max() <= far + 1e-7 and far <= radius
    for above, below in zip(levels, levels[1:], strict=False):
        assert set(above.centres) <= set(below.centres) and set(above.starts) <= set(below.starts)


def test_groups_of_near_copies_are_linked_as_wholes(monkeypatch):
    rng = np.random.default_rng(9)
    raw = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.05
    block = cover_tree.Block.of(raw, np.arange(1500), np.full(1500, 3))
    compared = []
    look = cover_tree.Traversal._look
    monkeypatch.setattr(cover_tree.Traversal, "_look", lambda self, u, *a: (compared.append(len(u)), look(self, u, *a))[1])
    found = cover_tree.Traversal(block, None, 0.93)
    assert (found.counts[0] == 3 * 1499).all() and not found.labels.any() and sum(compared) < 1500
