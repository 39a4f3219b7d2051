"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, row bigint, bucket string, n_words string, spans string"

WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text: str) -> str:
    return text.translate(_LOWER)


def documents() -> list[tuple]:
    """(doc_id, text, lang, and columns whose names clash with the operators' own)."""
    rnd = random.Random(11)
    common = [f"w{k}" for k in range(60)]
    base = " ".join(rnd.choice(common) for _ in range(90))
    near = base.split()
    near[40] = "changed"
    passage = " ".join(rnd.choice(common) for _ in range(60))
    long = " ".join(rnd.choice(common) + rnd.choice(["", ",", "."]) for _ in range(9000))
    item = "Each of the small boxes on that table holds exactly seven red marbles and one blue marble so count them"
    texts = [
        base, base, " ".join(near), base + " tail words here", None, "", " \n\t ", "one", "ONE", "a b c d",
        "alpha " + passage + " omega", "beta " + passage + " gamma delta", long, long[:70_000],
        "same line\nsame line\nother\n" + base[::-1], "é" * 300, "日本語 テスト " * 40, "x" * 900,
        "Licensed under the Apache License, Version 2.0. All rights reserved.", "Text about nothing. " + item + ". More text.",
        "\x00\x01 odd \x7f bytes   here", "scum idiot " * 30, "Cc By all rights reserved cc-by 4.0",
        "a <|endoftext|> b", ("some words here  <|endoftext|>" + "x" * 7) * 60, "<|STARTOFTEXT|>don't<|startoftext|>",
    ]
    rows = [(k, t, ("en", "fr", None)[k % 3], k, "x", "y", None) for k, t in enumerate(texts)]
    rows.append((3, texts[3], "en", 0, None, None, None))  # a row that repeats
    rows.append((None, "an id that is not known", None, None, None, None, None))
    return rows


def ids_and_texts(rows) -> list[tuple]:
    return [(r[0], r[1] or "") for r in rows]


def words(text: str) -> list[str]:
    return WORD.findall(text)


def components(rows, width: int = 5, threshold: int = 80) -> Counter:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = []
    for _, text in rows:
        w = words(lower(text))
        whole = [tuple(w)] if w else []
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset(whole))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return Counter((d, len(sets[k]), least[root(k)] if sets[k] else d) for k, (d, _) in enumerate(rows))


def cuts(rows, length: int = 200) -> Counter:
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what stays) of each row."""
    seen: Counter = Counter()
    data = [t.encode() for _, t in rows]
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out: Counter = Counter()
    for (doc_id, _), b in zip(rows, data, strict=True):
        covered = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        spans = sum(covered[i] and not covered[i - 1] for i in range(1, len(b))) + bool(covered[0])
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        out[doc_id, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = Counter(x for x in text.split("\n") if words(x))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, sum(lines.values()) - len(lines), len(repeated)


def remainder(doc_id, modulus: int) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def unigram_base(rows, modulus: int = 7, held_out: int = 2):
    """train_tokens, and (doc_id, n_tokens, n_known, base) of each row."""
    import math

    counts: Counter = Counter()
    tokens = [[*lower(t).encode().split(), "end"] for _, t in rows]
    for (d, _), w in zip(rows, tokens, strict=True):
        if remainder(d, modulus) != held_out:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return n, [
        (d, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for (d, _), w in zip(rows, tokens, strict=True)
    ]


def license_places(text: str) -> tuple:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    found = defaultdict(list)
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                found[label].append(i)
    places = [i for x in found.values() for i in x]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))
