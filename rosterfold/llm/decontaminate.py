"""Benchmark decontamination by templates: re-parameterised questions are found as well as copies.

Texts are cut into tokens (letters, digits and characters beyond ASCII). A token
becomes a typed placeholder if it is a number, a unit behind a number, or a name
(a capital inside a sentence); other tokens are lower-cased. Windows of
``WINDOW`` template tokens of all documents are hash-joined with those of the
benchmark, and so are windows of the lower-cased tokens themselves. Template windows of more than
``SLOTS`` placeholders say too little to start a hit; literal ones have no such limit, so copies are
found however many numbers or names they hold and whatever their case. The hits of a document and an item
are then aligned, and on each alignment that has a hit all windows are compared, dense ones too. A run
counts only if its slots are consistent: one value of the item always stands for
one and the same value in the document, so "3 apples and 3 pears" matches
"5 apples and 5 pears" but not "5 apples and 7 pears". A document is contaminated by
an item if consistent runs cover ``SHARE`` of all the item's windows.

The benchmark is the query set. It is held in blocks of ``BLOCK_BYTES`` of text, so
what tasks are sent is bounded; a larger benchmark makes more passes.

Null and empty texts, of documents or items, match nothing. An item with fewer tokens
than a window is one window of its own length; below ``SHORTEST`` it is matched literally
only, as its template cannot be told from chance. Rows that repeat give
results that repeat; null ids stay. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import parts, prepare, slices, text_bytes, texts
from rosterfold.llm.words import joined, mix, powers, prefix_hashes, runs, span_hashes

WINDOW = 8
SHORTEST = 5
SHARE = 0.5

#: Placeholders that one window may hold; with more, its literal words say too little.
SLOTS = 4

BLOCK_BYTES = 1 << 22

#: Unit words behind a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr hrs ms meter meters metre metres mile miles "
    "kilometer kilometers foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros percent degree degrees volt volts watt watts mph kmh"
).split()

NUMBER, NAME, UNIT = 1, 2, 3

_PLACEHOLDERS = mix(np.arange(11, 15, dtype=np.uint64))


class Templates:
    """Template tokens of many texts: owner, place, kind (0: literal), hash."""

    def __init__(self, found: list[bytes]) -> None:
        data, first, last = joined(found)
        self.data = data
        owners = np.repeat(np.arange(len(found)), last - first + 1)
        capital = (data >= 65) & (data <= 90)
        after = np.concatenate(([0], data[:-1])) == 0xC3
        wide = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        small = data + (capital | wide).astype(np.uint8) * np.uint8(32)
        digit = (data >= 48) & (data <= 57)
        self.small = small
        self.starts, self.ends = runs(digit | ((small >= 97) & (small <= 122)) | (data >= 0x80))
        self.owner = owners[self.starts]
        digits = np.concatenate(([0], np.cumsum(digit)))
        number = digits[self.ends] - digits[self.starts] == self.ends - self.starts
        self.hash = span_hashes(prefix_hashes(small), self.starts, self.ends)

        # the last byte before each place that is no blank tells whether a sentence starts there
        seen = np.where((data == 32) | (data == 9), -1, np.arange(len(data)))
        seen = np.concatenate(([-1], np.maximum.accumulate(seen)))[self.starts]
        opens = (seen < 0) | np.isin(data[seen], np.frombuffer(b".!?:;\n\"'([{*#-|", np.uint8))
        big = capital[self.starts] | (self.starts + 1 < len(data)) & wide[np.minimum(self.starts + 1, len(data) - 1)]
        unit = np.isin(self.hash, _UNIT_HASHES)
        unit[1:] &= number[:-1] & (self.owner[1:] == self.owner[:-1])
        unit[:1] = False
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(big & ~opens, NAME, 0)))
        self.key = np.where(self.kind > 0, _PLACEHOLDERS[self.kind], self.hash)

        self._slots = np.concatenate(([0], np.cumsum(self.kind > 0)))
        up, _ = powers(len(self.key))
        self._sums = [np.concatenate(([np.uint64(0)], np.cumsum(x * up))) for x in (self.key, self.hash)]

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of ``size`` tokens: literal ones, or templates with enough literal words."""
        n = len(self.key) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        good = self.owner[:n] == self.owner[size - 1 :]
        if not literal:
            good &= self._slots[size:] - self._slots[:n] <= min(SLOTS, size // 2)
        places = np.flatnonzero(good)
        sums, (_, down) = self._sums[literal], powers(len(self.key))
        return places, mix((sums[places + size] - sums[places]) * down[places] + np.uint64(2 * size + literal))

    def token(self, k: int) -> bytes:
        return self.small[self.starts[k] : self.ends[k]].tobytes()


_UNIT_DATA, _UNIT_FIRST, _UNIT_LAST = joined([u.encode() for u in UNITS])
_UNIT_HASHES = np.sort(span_hashes(prefix_hashes(_UNIT_DATA), _UNIT_FIRST, _UNIT_LAST))


class Benchmark:
    """The items of one block and their windows, sorted by hash."""

    def __init__(self, ids: list, found: list[bytes]) -> None:
        self.ids = ids
        t = self.templates = Templates(found)
        sizes = np.bincount(t.owner, minlength=len(ids))
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.size = np.minimum(sizes, WINDOW)
        self.n_windows = np.where(sizes > 0, sizes - self.size + 1, 0)
        self.tables = []
        for size in np.unique(self.size[self.size > 0]).tolist():
            for literal in (False, True) if size >= SHORTEST else (True,):
                places, keys = t.windows(size, literal)
                own = self.size[t.owner[places]] == size
                places, keys = places[own], keys[own]
                order = np.argsort(keys, kind="stable")
                if len(order):
                    self.tables.append((size, literal, keys[order], places[order]))

    def hits(self, docs: Templates) -> dict[tuple[int, int], set]:
        """By document and item: (token of the document minus token of the item) of each alignment with an equal window."""
        out = defaultdict(set)
        for size, literal, keys, places in self.tables:
            at, found = docs.windows(size, literal)
            low = np.searchsorted(keys, found)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == found)
            high = np.searchsorted(keys, found[hit], side="right")
            times = high - low[hit]
            here = np.repeat(at[hit], times)
            there = places[np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            all_ = np.stack([docs.owner[here], self.templates.owner[there], here - there], axis=1)
            for d, i, shift in np.unique(all_, axis=0).tolist():
                out[d, i].add(shift)
        return out

    def judge(self, docs: Templates, d: int, i: int, shifts: set) -> tuple[set, bool, int, int]:
        """The item's windows that consistent runs cover, whether all slots are equal, first and last token."""
        t, size = self.templates, int(self.size[i])
        covered, exact, low, high = set(), True, None, None
        for shift in sorted(shifts):
            # the part of the item that lies on the document in this alignment
            first, past = max(int(self.first[i]), -shift), min(int(self.first[i + 1]), len(docs.key) - shift)
            there = np.arange(first, past)
            here = there + shift
            inside = docs.owner[here] == d
            literal = _full(inside & (docs.hash[here] == t.hash[there]), size)
            same = _full(inside & (docs.key[here] == t.key[there]), size) if size >= SHORTEST else literal & False
            slots = np.concatenate(([0], np.cumsum(t.kind[there] > 0)))
            seeds = same & (slots[size:] - slots[:-size] <= min(SLOTS, size // 2))
            # dense windows count beside a seed, unless only they are inconsistent
            for run in (same | literal, seeds | literal, seeds) if seeds.any() else (literal,):
                tokens = np.unique(np.flatnonzero(run)[:, None] + np.arange(size))
                pairs: dict[bytes, set] = defaultdict(set)
                for k in tokens[(docs.kind[here[tokens]] > 0) | (t.kind[there[tokens]] > 0)].tolist():
                    pairs[t.token(there[k])].add(docs.token(here[k]))
                if all(len(values) == 1 for values in pairs.values()):
                    break
            else:
                continue
            covered |= set(there[np.flatnonzero(run)].tolist())
            exact &= all(values == {value} for value, values in pairs.items())
            ends = (int(here[tokens[0]]), int(here[tokens[-1]]))
            low = ends[0] if low is None else min(low, ends[0])
            high = ends[1] if high is None else max(high, ends[1])
        return covered, exact, low, high


def _full(equal: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` tokens is equal throughout."""
    sums = np.concatenate(([0], np.cumsum(equal)))
    return sums[size:] - sums[:-size] == size


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, n_hits, n_windows, coverage, exact, start, past.

    ``start`` and ``past`` are byte places of what matched; ``exact`` is false where slots were filled anew.
    """
    prepare(docs.sparkSession)
    names = [c.split()[0] for c in _HITS.split(",")]
    out = None
    for block in _blocks(benchmark):

        def report(batches, block=block):
            queries = Benchmark(*block.value)
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], *hit) for d, hit in search(queries, texts(batch.column("text")), share)]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64(), pa.bool_()] + [pa.int64()] * 2
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        part = docs.select("doc_id", "text").mapInArrow(report, _HITS)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    prepare(docs.sparkSession)
    place = docs.columns.index("text")
    for block in _blocks(benchmark):

        def keep(batches, block=block):
            queries = Benchmark(*block.value)
            for batch in slices(batches):
                good = np.ones(batch.num_rows, bool)
                good[[d for d, _ in search(queries, texts(batch.column(place)), share)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


_HITS = (
    "doc_id bigint, item_id bigint, n_hits bigint, n_windows bigint, coverage double, exact boolean,"
    " start bigint, past bigint"
)


def search(queries: Benchmark, found: list[bytes], share: float):
    """(number of the text, (item_id, hits, windows, coverage, exact, start, past)) of each item found."""
    templates = Templates(found)
    base = np.cumsum([0, *(len(t) + 1 for t in found)])
    for (d, i), shifts in queries.hits(templates).items():
        covered, exact, low, high = queries.judge(templates, d, i, shifts)
        total = int(queries.n_windows[i])
        if covered and len(covered) >= share * total:
            start, past = int(templates.starts[low] - base[d]), int(templates.ends[high] - base[d])
            yield d, (queries.ids[i], len(covered), total, len(covered) / total, exact, start, past)


def _blocks(benchmark: DataFrame) -> list:
    """The items in broadcast blocks of about ``BLOCK_BYTES`` of text each."""
    items = benchmark.select("item_id", "text").where("char_length(text) > 0")
    n = parts(text_bytes(items), BLOCK_BYTES, least=1)
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        out.append(items.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text.encode() for r in rows])))
    return out
