"""Each operator on small documents with awkward cases, against a brute-force version or an exact round trip."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rosterfold.llm import (
    components,
    context_tree,
    decontaminate,
    encoding,
    language,
    licenses,
    ngram_join,
    packing,
    quality,
    records,
    suffix_dedup,
    token_counts,
)
from tests.llm import cases

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return cases.ids_and_texts(cases.documents())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def library_ids(path: str, texts: list[str]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_gives_the_library_s_ids():
    rnd = random.Random(1)
    alphabet = list("aBs '\n\t.,9é½Σ́\xa0²\x1c😀Ǆ|")
    texts = ["", " ", "it's DON'T'll", "ΟΔΟΣ", "é x İ", "<|endoftext|>", "a\r\n\r\n  b   "]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "<|endoftext|><|endoftext|>"]
    texts += [a + t + b for t in special for a in ("", "don't é", "  ", "a\n", "<|") for b in ("", " b", "  ", "|>", "日本 x")]
    texts += ["".join(rnd.choice([*alphabet, *special]) for _ in range(rnd.randint(1, 12))) for _ in range(1000)]
    for path in (BYTES, WORDS):
        got = encoding.Encoder(path).batch([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(path, texts)


def test_context_tree_base_and_cases(docs, pairs, empty):
    got = context_tree.score(docs).collect()
    n, expected = cases.unigram_base(pairs)
    assert {r.train_tokens for r in got} == {n}
    found = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert found == Counter((d, t, k, round(b, 6)) for d, t, k, b in expected)
    assert all(r.held_out == (cases.remainder(r.doc_id, 7) == 2) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert context_tree.score(empty).collect() == []


def test_context_tree_units_of_whole_texts():
    """Units are found for all texts of a batch at once; they once were one object each, which took most of the time."""
    rng = np.random.default_rng(3)
    pieces = [b"a", b"AB", b"\x00", b"\xc3\xa9", b" ", b"\t", b"\n\r", b"\x0b\x0c", b"\x1c", b"wordword", b"longer" * 30, b"longer" * 30 + b"s"]
    found = [b"".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 40))) for _ in range(300)] + [b"", b" ", b"x"]
    want = [context_tree.units(text.lower().split()) for text in found]
    flat = [unit for own in want for unit in own]
    got, sizes = context_tree.split(found)
    assert sizes.tolist() == list(map(len, want))
    blob, end = got.joined(np.arange(len(flat)))
    assert blob == b"\n".join(flat) + b"\n" and end[-1] == len(blob)
    again = context_tree.parse(blob[:-1])
    for name in ("hash", "word_hash", "size"):
        assert np.array_equal(getattr(got, name), getattr(again, name))
    assert len(set(got.hash.tolist())) == len(set(flat))
    assert len(set(got.word_hash.tolist())) == len({unit[unit.index(b" ") + 1 :] for unit in flat})
    order = got.in_order(np.arange(len(flat)), got.word_hash.astype(np.int64) & 3)
    assert sorted(order.tolist()) == list(range(len(flat)))
    empty, sizes = context_tree.split([b"", b"\n"])
    assert len(empty.hash) == 0 and sizes.tolist() == [0, 0]


def test_context_tree_matches_a_plain_recursion():
    """Trees of a few words, by the definition: half the own estimate, half the longer contexts' product."""
    vocabulary = {b"ab": 3, b"abc": 1, b"b": 2, b"never": 0}
    words = b"\n".join(sorted(vocabulary))
    context, byte, count, _, _ = context_tree.contexts(words, np.array([vocabulary[w] for w in sorted(vocabulary)]))
    tree = context_tree.Tree(context, byte, count, floor=2)

    def own(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    rows = list(zip(context.tolist(), byte.tolist(), count.tolist(), strict=True))

    def weighted(depth, prefix, number):
        level = number.bit_length() - 1
        here = [r for r in rows if r[0] >> (64 - 8 * depth) == prefix and (1 << level | r[1] >> (8 - level)) == number]
        ones = sum(c for _, b, c in here if b >> (7 - level) & 1)
        alone = own(sum(c for _, _, c in here) - ones, ones)
        if depth == context_tree.DEPTH:
            return alone
        longer = sum(weighted(depth + 1, p, number) for p in {r[0] >> (64 - 8 * depth - 8) for r in here})
        return math.log(0.5 * math.exp(alone) + 0.5 * math.exp(longer))

    number, _, _, both = tree.nodes(2)
    found = Counter((k, round(b, 7) + 0.0) for k, b in zip(number.tolist(), both.tolist(), strict=True))
    keys = {(r[0] >> 48, 1 << j | r[1] >> (8 - j)) for r in rows for j in range(8)}
    assert found == Counter((k, round(weighted(2, p, k), 7) + 0.0) for p, k in keys)


def _mixed_probability(prefix: bytes, byte: int, history: Counter) -> float:
    """Probability of a byte after ``prefix`` (nearest byte last), by the definition of the weighted tree."""

    def own(zeros, ones):
        return math.exp(math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1))

    def counts(suffix, number):
        level = number.bit_length() - 1
        here = [(b, c) for (p, b), c in history.items() if p.endswith(suffix) and (1 << level | b >> (8 - level)) == number]
        ones = sum(c for b, c in here if b >> (7 - level) & 1)
        return sum(c for _, c in here) - ones, ones

    def weight(suffix, number):
        zeros, ones = counts(suffix, number)
        if len(suffix) == context_tree.DEPTH:
            return own(zeros, ones)
        longer = 1.0
        for before in {p[-len(suffix) - 1] for p, _ in history if p.endswith(suffix)}:
            longer *= weight(bytes([before]) + suffix, number)
        return 0.5 * own(zeros, ones) + 0.5 * longer

    out = 1.0
    for j in range(8):
        number, bit = 1 << j | byte >> (8 - j), byte >> (7 - j) & 1
        mixed = None
        for d in range(context_tree.DEPTH, -1, -1):
            suffix = prefix[len(prefix) - d :]
            zeros, ones = counts(suffix, number)
            estimate = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
            if mixed is None or not sum(counts(prefix[len(prefix) - d - 1 :], number)):
                mixed = estimate
            else:
                share = 0.5 * own(zeros, ones) / weight(suffix, number)
                mixed = share * estimate + (1 - share) * mixed
        out *= mixed
    return out


def test_context_tree_scores_by_the_definition(spark):
    rows = [(1, "ab ba"), (2, "ab ab b"), (3, "ba é"), (5, "ab ba q"), (None, "b")]
    found = {r.doc_id: r for r in context_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    def coded(text):
        words = text.lower().encode().split()
        for unit in context_tree.units(words):
            tail = unit[: unit.index(b" ") + 1]
            data = unit + b" "
            for k in range(len(tail), len(data)):
                yield data[:k].rjust(context_tree.DEPTH, b"\0")[-context_tree.DEPTH :], data[k]
        yield b" ".rjust(context_tree.DEPTH, b"\0"), 10

    history = Counter(p for d, t in rows if cases.remainder(d, 7) != 2 for p in coded(t))
    for doc_id, text in rows:
        bits = [math.log10(_mixed_probability(prefix, byte, history)) for prefix, byte in coded(text)]
        assert found[doc_id].score == pytest.approx(sum(bits), rel=1e-9), text
        assert found[doc_id].bits_per_byte == pytest.approx(-sum(bits) * math.log2(10) / len(bits), rel=1e-9)


def test_context_tree_sees_the_order_of_words(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_TEXTS", 7)
    text = "the cat sat on the mat"
    rows = [(k, text) for k in range(61)] + [(100, "mat the on sat cat the"), (101, "cat the the mat on sat"), (102, "the " * 30_000)]
    found = {r.doc_id: r for r in context_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(found) == 64
    assert found[0].score > max(found[k].score for k in (100, 101)) + 1
    assert found[100].base_score == pytest.approx(found[0].base_score) and found[102].n_tokens == 30_001


def test_context_tree_prefers_what_it_learned(spark):
    rows = [(k, "the cat sat on the mat") for k in range(60)] + [(1000, "the cat sat"), (1001, "zqj xvk wpf")]
    got = {r.doc_id: r.score for r in context_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1000] > got[1001] + 10


def test_token_counts(docs, pairs, empty):
    ids = library_ids(BYTES, [t for _, t in pairs])
    expected = Counter((d, len(t.encode()), len(i), len(i) > 512) for (d, t), i in zip(pairs, ids, strict=True))
    for chunk, overlap in ((1 << 16, 1 << 10), (500, 40), (64, 4)):
        got = token_counts.token_counts(docs, BYTES, chunk=chunk, overlap=overlap).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
        if chunk == 64:
            assert max(r.n_chunks for r in got if r.doc_id == 17) == 1  # one word of 900 letters: widened to the whole
            assert max(r.n_chunks for r in got) > 100
    assert token_counts.token_counts(empty, BYTES).collect() == []


def test_ngram_join(docs, pairs, empty):
    expected = cases.components(pairs)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert ngram_join.near_duplicates(empty).collect() == []
    kept = ngram_join.representatives(docs).collect()
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == sum(r.doc_id is not None for r in kept)
    assert ngram_join.representatives(docs).columns == docs.columns


@pytest.mark.parametrize("common, paired, block, columns", [(2, 400, 1024, 2048), (2, 30, 3, 7)])
def test_ngram_join_frequent_tokens(spark, monkeypatch, common, paired, block, columns):
    """Large groups of near copies, and passages that dissimilar documents share, through the frequent class."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "_COLUMNS", columns)
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for size in (25, 60, 60, 120):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(size)] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: int(size * rnd.uniform(0.8, 1))])))
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        rows.append((len(rows), " ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 30))])))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.components(rows)


def test_bands_of_sizes_hold_all_links():
    """Sizes whose ratio is the threshold itself are in neighbouring bands."""
    step = -math.log(0.8) * (1 + 1e-9)
    for small in range(1, 20_000):
        large = small * 100 // 80
        assert math.floor(math.log(large) / step) - math.floor(math.log(small) / step) in (0, 1)


def test_representatives_are_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [
        (None, text, "b", 1), (None, text, "a", 2), (None, text, "a", 2), (7, text + " more", "c", 3),  # one group
        (9, "quite another text than the others have here", "d", 4), (9, "and one more of the same id but unlike it", "e", 5),
        (None, "a text that stands alone without an id", "f", 6), (None, "a text that stands alone without an id", "g", 7),
        (1, None, "h", 8), (1, None, "h", 8), (2, " \n", "i", 9), (None, "", "j", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n int").repartition(3)
    kept = Counter(tuple(r) for r in ngram_join.representatives(docs).collect())
    assert kept == Counter([rows[3], rows[4], rows[5], rows[6], *rows[8:]])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_two_stage_sort():
    rnd = random.Random(2)
    for _ in range(60):
        found = [bytes(rnd.choice(b"ab\x00z") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8))]
        sizes = np.array([len(x) for x in found])
        end = np.cumsum(sizes)
        text = np.frombuffer(b"".join(found), np.uint8)
        order = suffix_dedup.two_stage_sort(text, end - sizes, end, np.ones(len(text), bool), 1000)
        owner = np.repeat(np.arange(len(found)), sizes)
        keys = [found[owner[i]][i - (end - sizes)[owner[i]] :] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        shared = suffix_dedup.common_prefixes(text, order, np.repeat(end, sizes) - np.arange(len(text)), 200)
        for x, y, n in zip(keys, keys[1:], shared.tolist(), strict=False):
            assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1] or n == min(len(x), len(y))


def test_suffix_dedup(docs, pairs, empty):
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(docs)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cases.cuts(pairs)
    assert suffix_dedup.dedup_substrings(empty).collect() == []
    assert suffix_dedup.cut_documents(docs).columns == docs.columns


def test_quality(docs, pairs, empty):
    found = quality.ledger(docs).cache()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = Counter((d, *cases.measures(t)) for d, t in pairs)
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in found.collect()) == expected
    kept = {r.doc_id for r in found.where(quality.kept("web_v2")).collect()}
    assert 21 not in kept and 0 in kept and 4 not in kept
    rows = {(r.policy, r.rule): r for r in quality.ablation(found).collect()}
    every = [r.failed for r in found.collect()]
    mask = quality.mask(quality.POLICIES["web_v2"])
    for k, rule in enumerate(quality.RULES):
        row = rows["web_v2", rule]
        assert row.n_docs == len(every) and row.n_failed == sum(f >> k & 1 for f in every)
        assert row.n_only == sum(f & mask == 1 << k for f in every)
    passed = quality.passing(docs, "web_v2")
    assert passed.columns == docs.columns
    assert Counter(r.doc_id for r in passed.collect()) == Counter(r.doc_id for r in found.where(quality.kept("web_v2")).collect())
    assert quality.ledger(empty).collect() == []


def test_records(spark, docs, pairs, tmp_path):
    files = records.write(docs, WORDS, 1, folder=f"file://{tmp_path}/out")
    order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, []
    for (d, _), ids in zip(order, library_ids(WORDS, [t for _, t in order]), strict=True):
        ids = [*ids, 1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in records.read(spark, files).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    first = files.orderBy("shard").first()
    picked = records.read_at(first.file, [first.n_records - 1, 0])
    assert picked[1][0] is None and [len(ids) for _, ids in picked] == [expected[first.n_records - 1][2], expected[0][2]]
    damaged = bytearray(open(first.file.removeprefix("file://") + ".seq", "rb").read())
    damaged[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        at = len(records.MAGIC) + 1
        while at < len(damaged):
            at += len(records.payload_at(damaged, at)) + 16


def test_records_of_nothing(spark, empty):
    assert records.read(spark, records.write(empty, WORDS, 1)).collect() == []


def test_packing(docs, pairs, empty):
    capacity = 64
    got = packing.pack_documents(docs, WORDS, 0, capacity).collect()
    expected: Counter = Counter()
    for (d, _), ids in zip(pairs, library_ids(WORDS, [t for _, t in pairs]), strict=True):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    windows: dict = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(windows) <= -(-sum(r.length for r in got) // capacity) + 1
    assert packing.pack_documents(empty, WORDS).collect() == []


def fewest(sizes: list[int], capacity: int) -> int:
    """The optimum, by trying every window for every piece."""
    best = len(sizes)

    def place(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms) if room >= sizes[k]}.values():
            place(k + 1, [r - sizes[k] * (j == i) for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def windows_of(counts: Counter, capacity: int) -> int:
    """Number of windows of the plan, which must use all pieces."""
    found = packing.plan(counts, capacity)
    assert all(times > 0 and sum(sizes) <= capacity for times, sizes in found)
    used = Counter()
    for times, sizes in found:
        for size in sizes:
            used[size] += times
    assert used == Counter({n: c for n, c in counts.items() if c})
    return sum(times for times, _ in found)


def test_plan_is_optimal_on_small_tables():
    rnd = random.Random(1)
    hard = [57, 57, 48, 45, 45, 39, 38, 37, 32, 32, 24, 15]
    assert windows_of(Counter(hard), 100) == 5
    for _ in range(400):
        capacity = rnd.choice([20, 50, 100])
        sizes = [rnd.randint(1, max(1, int(capacity * rnd.choice([0.3, 0.6, 1])))) for _ in range(12)]
        assert windows_of(Counter(sizes), capacity) == fewest(sizes, capacity), sizes


def test_plan_fills_windows_that_were_cut_from_full_ones():
    for seed in range(4):
        rnd = random.Random(seed)
        counts: Counter = Counter()
        for _ in range(400):
            rest = 2048
            while rest:
                size = min(rest, rnd.randint(1, rnd.choice([300, 900, 2048])))
                counts[size] += 1
                rest -= size
        assert windows_of(counts, 2048) == 400


def test_plan_of_single_lengths():
    for n in [*range(1, 70), *range(70, 2049, 97), 2048]:
        assert windows_of(Counter({n: 5000}), 2048) == -(-5000 // (2048 // n))
        assert windows_of(Counter({n: 5000, 3: 1}), 2048) <= -(-5000 // (2048 // n)) + 1
    assert windows_of(Counter({2: 5000, 3: 1}), 2048) == 5


def test_fullest_filling_by_sums():
    rnd = random.Random(9)
    for _ in range(300):
        counts = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(0, 9)))
        room = rnd.randint(0, 90)
        lengths = sorted(counts, reverse=True)
        found = packing._fullest(lengths, counts, room)
        assert all(0 < k <= counts[n] for n, k in found)
        reach = {0}
        for n in counts.elements():
            reach |= {s + n for s in reach}
        assert sum(n * k for n, k in found) == max(s for s in reach if s <= room)
        assert sum(packing.fill(lengths, counts, room)) == max(s for s in reach if s <= room)


def test_plan_uses_every_piece_and_few_windows():
    rnd = random.Random(3)
    for n in (1, 50, 20_000):
        counts = Counter(min(2048, max(1, int(rnd.lognormvariate(6.3, 1)))) for _ in range(n))
        used: Counter = Counter()
        windows = packing.plan(counts, 2048)
        for times, sizes in windows:
            assert sum(sizes) <= 2048
            for size in sizes:
                used[size] += times
        assert used == counts
        fewest = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert sum(t for t, _ in windows) <= max(fewest * 1.1, fewest + 1)
    assert packing.fill([7, 5, 3], {7: 1, 5: 2, 3: 1}, 10) == [7, 3]  # best fit finds it
    assert packing.fill([6, 5], {6: 1, 5: 2}, 10) == [5, 5]  # best fit does not


def test_language(spark, empty):
    rnd = random.Random(4)
    parts_ = {"en": "the and ing tion of that with er".split(), "de": "der die und schein keit ung ver ein".split()}
    rows = []
    for k in range(300):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join("".join(rnd.choices(parts_[lang], k=2)) for _ in range(40)), lang))
    mixed = " ".join("".join(rnd.choices(parts_[x], k=2)) for _ in range(60) for x in ("en", "de"))
    rows += [(1000, mixed, None), (1001, None, "en"), (1002, "12 34 !!", None), (None, "der die und", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify(docs, language.train(docs)).collect()
    got = {r.doc_id: r for r in found}
    held = [r for r in found if r.held_out and r.doc_id < 1000]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in held)
    assert set(got[1000].langs) == {"en", "de"} and all(0.35 < p < 0.65 for p in got[1000].langs.values())
    assert len(got[0].langs) == 1
    assert (got[1001].lang_pred, got[1001].score) == ("und", 0) == (got[1002].lang_pred, got[1002].score)
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(rows)
    assert language.identify(empty, language.train(empty)).collect() == []
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled, language.train(unlabelled)).collect()} == {"und"}


def test_decontaminate(spark, docs, empty):
    item = "Each of the small boxes on that table holds exactly seven red marbles and one blue marble so count them"
    slots = "Tom has 3 apples and 3 pears so how many fruits does he have in total today?"
    items = [(1, item), (2, slots), (3, None), (4, ""), (5, "too short"), (6, "five words are one window")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {(19, 1)} and got[19, 1].exact
    text = cases.documents()[19][1].encode()
    assert text[got[19, 1].start : got[19, 1].past].decode() in item
    asked = [
        (1, "Well. Anna has 5 apples and 5 pears so how many fruits does she have? Tom has 9 apples and 9 pears so how many fruits does he have in total today?"),
        (2, "Tom has 5 apples and 7 pears so how many fruits does he have in total today?"),
        (3, "we say five words are one window"),
        (None, slots),
    ]
    more = spark.createDataFrame(asked, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.exact) for r in decontaminate.decontaminate(more, bench).collect()} == {
        (1, 2, False), (3, 6, True), (None, 2, True),
    }
    assert [r.doc_id for r in decontaminate.clean(more, bench).collect()] == [2]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(empty, bench).collect() == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).collect() == []


def test_licenses(spark, docs, pairs, empty):
    found = licenses.scan(docs)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.collect())
    assert got == Counter((d, *cases.license_places(t)) for d, t in pairs)
    texts = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "Released under the MIT License": "mit",
        "accby cc byx": "",
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    assert [r.labels for r in licenses.scan(rows).orderBy("doc_id").collect()] == list(texts.values())
    assert len(licenses.rules()) > 200
    assert licenses.scan(empty).collect() == []
