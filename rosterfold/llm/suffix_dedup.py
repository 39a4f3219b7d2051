"""Removal of long byte strings that occur more than once, by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in
the same document or another. Three steps find such strings.

1. *Anchors.* Of the grams (``GRAM`` bytes) inside each string the one with the least
   hash is its anchor; equal strings have equal anchors at equal places. Anchors are
   counted over all documents, and a Bloom filter keeps those that occur twice. A
   string whose anchor occurs once has no equal; false positives cost work only.
2. *Suffix sorting.* Neighbouring strings with one anchor form a region; regions go to
   the bucket of their anchor, so equal strings meet. Each bucket's regions are one
   text whose suffixes are sorted in two stages: suffixes smaller than their
   successor are sorted directly, the others are induced by scanning the buckets of first
   bytes in order. Adjacent suffixes with a common prefix of ``LENGTH`` bytes are
   the repeated strings. Regions that are equal as a whole are collapsed first, in the
   tasks that make them and again in the bucket.
3. *Cutting.* The repeated strings of a document are joined to it, and their bytes cut.

Texts are UTF-8 bytes and matches never cross documents. Null texts are empty; texts
shorter than ``LENGTH`` lose nothing; rows that repeat are copies of each other and
lose all that is long enough; null ids stay; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import blob, parts, prepare, slices, text_bytes, texts
from rosterfold.llm.filters import Filter, token_filters
from rosterfold.llm.words import joined, prefix_hashes, runs, span_hashes

LENGTH = 200
GRAM = 32

#: Bytes of text to a bucket of anchors, and to a bucket of regions.
ANCHOR_BYTES = 1 << 26
REGION_BYTES = 1 << 21

#: Bytes of regions that a task collapses before it passes them on.
HELD = 1 << 25


def _strings(found: list[bytes], length: int, gram: int):
    """Joined texts, where each begins, and of every string its text, whether it ends in it, its anchor's place and hash."""
    data, first, last = joined(found)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return data, first, none, none.astype(bool), none, none.astype(np.uint64)
    starts = np.arange(len(data) - gram + 1)
    hashes = span_hashes(prefix_hashes(data), starts, starts + gram)
    anchor = _least(hashes, length - gram + 1)
    owner = np.repeat(np.arange(len(found)), last - first + 1)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= last[owner]
    return data, first, owner, valid, anchor, hashes[anchor]


def _least(hashes: np.ndarray, span: int, piece: int = 1 << 24) -> np.ndarray:
    """Of each ``span`` neighbouring hashes the place of the least (by all but 24 bits; ties: the first).

    The low 24 bits of a hash give way to its place, so places count from the start of a
    piece; pieces overlap by ``span`` - 1 places.
    """
    low = np.uint64(0xFFFFFF)
    out = np.empty(len(hashes) - span + 1, np.int64)
    for at in range(0, len(out), piece - span + 1):
        part = hashes[at : at + piece]
        least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        out[at : at + len(least)] = (least & low).astype(np.int64) + at
    return out


def _stretches(key: np.ndarray, owner: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of valid strings of one text with one key."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]) & valid[1:] & valid[:-1]
    return np.flatnonzero(valid & np.concatenate(([True], ~same))), np.flatnonzero(valid & np.concatenate((~same, [True])))


def regions(found: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Stretches of strings with equal anchors: text number, first and last start in the text, anchor hash."""
    _, first, owner, valid, _, token = _strings(found, length, gram)
    head, tail = _stretches(token, owner, valid)
    return owner[head], head - first[owner[head]], tail - first[owner[head]], token[head]


def anchors(found: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The hash of each anchor, once for each place that it has in the texts."""
    _, _, owner, valid, anchor, token = _strings(found, length, gram)
    return token[_stretches(anchor, owner, valid)[0]]


def two_stage_sort(text: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the regions [begin, end) of ``text`` in order of their first ``depth`` bytes.

    Only ``wanted`` places, and those that follow one until a suffix is sorted
    directly, are sorted. A region's end is smaller than any byte.
    """
    n = len(text)
    is_last = np.zeros(n, bool)
    is_last[end - 1] = True
    is_first = np.zeros(n, bool)
    is_first[begin] = True
    turns = is_last.copy()
    turns[:-1] |= text[1:] != text[:-1]
    turn = np.where(turns, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = ~is_last[turn] & (text[turn] < text[np.minimum(turn + 1, n - 1)])  # smaller than its successor
    # from the last wanted place of a region on, induction needs what follows up to a directly sorted one
    taken = wanted.copy()
    edge = np.flatnonzero(wanted & ~small)
    while len(edge):
        edge = edge[~is_last[edge]] + 1
        edge = edge[~taken[edge]]
        taken[edge] = True
        edge = edge[~small[edge]]
    until = np.repeat(end, end - begin)
    direct = np.flatnonzero(taken & small)
    as_string = text.tobytes().decode("latin-1")
    heads = text[direct]
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    closing = np.flatnonzero(taken & is_last)
    for c in np.unique(text[closing]).tolist():
        pending[c].append(closing[text[closing] == c])
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        """The taken, not directly sorted places right before these, in their order."""
        places = places[~is_first[places]] - 1
        return places[taken[places] & ~small[places]]

    for c in range(256):
        parts_ = []
        generation = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(generation):
            parts_.append(generation)
            generation = before(generation)
            generation = generation[text[generation] == c]
        own = direct[heads == c]
        if len(own):
            keys = [as_string[i:j] for i, j in zip(own.tolist(), np.minimum(own + depth, until[own]).tolist(), strict=True)]
            parts_.append(own[sorted(range(len(own)), key=keys.__getitem__)])
            del keys
        pending[c] = []
        if not parts_:
            continue
        bucket = np.concatenate(parts_)
        out.append(bucket)
        induced = before(bucket)
        induced = induced[text[induced] > c]
        if len(induced):
            order = np.argsort(text[induced], kind="stable")
            induced = induced[order]
            cuts = np.flatnonzero(np.diff(text[induced])) + 1
            for group in np.split(induced, cuts):
                pending[text[group[0]]].append(group)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Bytes (up to ``depth``) that each suffix of ``order`` has in common with the next; ``room`` is what each place has."""
    first, second = order[:-1], order[1:]
    most = np.minimum(np.minimum(room[first], room[second]), depth)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(text) + 1,), (1,))
    common = np.zeros(len(first), np.int64)
    going = np.flatnonzero(most > 0)
    at = 0
    while len(going) and at < depth:
        x = words[np.minimum(first[going] + at, len(text))] ^ words[np.minimum(second[going] + at, len(text))]
        lowest = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        common[going] = np.minimum(at + same, most[going])
        at += 8
        going = going[(same == 8) & (most[going] > at)]
    return common


def repeated_strings(found: list[bytes], starts: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct regions with so many starts and copies: region number, first and last start of each run of repeated strings."""
    sizes = np.array([len(x) for x in found], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    text = np.frombuffer(b"".join(found), np.uint8)
    inside = np.arange(len(text)) - np.repeat(begin, sizes)
    wanted = inside < np.repeat(starts, sizes)
    order = two_stage_sort(text, begin, end, wanted, length)
    room = np.repeat(end, sizes) - np.arange(len(text))
    equal = common_prefixes(text, order, room, length) >= length
    again = np.repeat(times > 1, sizes) & wanted
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    again &= wanted
    again_first, again_last = runs(again)  # runs end with a region, as its last bytes start nothing
    region = np.searchsorted(end, again_first, side="right")
    return region, again_first - begin[region], again_last - 1 - begin[region]


_REGIONS = "bucket int, starts int, region binary, rows binary, lows binary"


def mark(docs: DataFrame, n: int, bits, length: int) -> DataFrame:
    """row, first, past: the byte ranges of ``docs`` (row, text) that repeated strings cover."""
    n_buckets, anchor_buckets = n, bits.value[1]

    def collect(batches):
        repeated = Filter(bits.value[0], anchor_buckets)
        held: dict[bytes, list] = {}
        kept = 0

        def flush():
            rows = []
            for region, (bucket, starts, of, lows) in held.items():
                rows.append((bucket, starts, region, blob(np.array(of, np.int64)), blob(np.array(lows, np.int64))))
            for k in range(0, len(rows), 4096):
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)],
                    names=[c.split()[0] for c in _REGIONS.split(", ")],
                )

        for batch in slices(batches):
            row = batch.column("row").to_pylist()
            found = texts(batch.column("text"))
            owner, low, high, token = regions(found, length)
            some = np.flatnonzero(repeated.has(token))
            bucket = (token[some] % np.uint64(n_buckets)).tolist()
            for b, d, i, j in zip(bucket, owner[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                region = found[d][i : j + length]
                have = held.get(region)
                if have is None:
                    held[region] = (b, j - i + 1, [row[d]], [i])
                    kept += len(region) + 300
                else:
                    have[2].append(row[d])
                    have[3].append(i)
                    kept += 16
            if kept > HELD:
                yield from flush()
                held, kept = {}, 0
        yield from flush()

    def sort(group):
        held: dict[bytes, int] = {}
        found, starts, rows, lows = [], [], [], []
        columns = (group.column(c).to_pylist() for c in ("region", "starts", "rows", "lows"))
        for region, n_starts, of, low in zip(*columns, strict=True):
            k = held.setdefault(region, len(found))
            if k == len(found):
                found.append(region)
                starts.append(n_starts)
                rows.append([])
                lows.append([])
            rows[k].append(of)
            lows[k].append(low)
        rows = [np.frombuffer(b"".join(x), np.int64) for x in rows]
        lows = [np.frombuffer(b"".join(x), np.int64) for x in lows]
        times = np.array([len(x) for x in rows])
        region, first, last = repeated_strings(found, np.array(starts), times, length)
        empty = [np.zeros(0, np.int64)]
        return pa.table(
            {
                "row": np.concatenate(empty + [rows[k] for k in region]),
                "first": np.concatenate(empty + [lows[k] + i for k, i in zip(region, first, strict=True)]),
                "past": np.concatenate(empty + [lows[k] + i + length for k, i in zip(region, last, strict=True)]),
            }
        )

    return (
        docs.select("row", "text").mapInArrow(collect, _REGIONS)
        .groupBy("bucket")
        .applyInArrow(sort, "row bigint, first bigint, past bigint")
    )


def spans_of(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, spans (first, past; not merged) of the texts of ``rows`` (row, text) that hold repeated strings."""
    spark = rows.sparkSession
    prepare(spark)
    nbytes = text_bytes(rows)
    n = parts(nbytes, ANCHOR_BYTES)
    first, _ = token_filters(rows, n, nbytes, lambda found: anchors(found, length), (1, 1))
    bits = spark.sparkContext.broadcast((first, n))
    marked = mark(rows.where(F.octet_length("text") >= length), parts(nbytes, REGION_BYTES), bits, length)
    return marked.groupBy("row").agg(F.collect_list(F.struct("first", "past")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for first, past in sorted((s["first"], s["past"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], past))
        else:
            out.append((first, past))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    stays, at = [], 0
    for first, past in spans:
        stays.append(text[at:first])
        at = past
    return b"".join([*stays, text[at:]])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def _spanned(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with their repeated spans as ``__spans``."""
    keyed = _keyed(docs)
    found = spans_of(keyed.select(F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text")), length)
    return keyed.join(found.select(F.col("row").alias("__row"), F.col("spans").alias("__spans")), "__row", "left").drop("__row")


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed, spans (removed byte ranges, maximal) of every document."""

    def cut(batches):
        for batch in slices(batches):
            found = texts(batch.column("text"))
            spans = [merged(s) for s in batch.column("__spans").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "kept": pa.array([without(t, s) for t, s in zip(found, spans, strict=True)], pa.binary()),
                    "n_bytes": pa.array([len(t) for t in found], pa.int64()),
                    "n_removed": pa.array([sum(j - i for i, j in s) for s in spans], pa.int64()),
                    "spans": pa.array(
                        [[{"first": i, "past": j} for i, j in s] for s in spans],
                        pa.list_(pa.struct({"first": pa.int64(), "past": pa.int64()})),
                    ),
                }
            )

    return _spanned(docs.select("doc_id", "text"), length).select("doc_id", "text", "__spans").mapInArrow(
        cut,
        "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<first:bigint,past:bigint>>",
    )


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``; rows without a word left go.

    Bytes of a character that was cut in two go with it. ``n_chars`` follows the
    text where there is such a column.
    """
    columns, place = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in slices(batches):
            kept = [
                t if not s else without(t.encode(), merged(s)).decode(errors="ignore")
                for t, s in zip(batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)
            ]
            arrays = [*batch.columns[:place], pa.array(kept, pa.string()), *batch.columns[place + 1 : len(columns)]]
            yield pa.record_batch(arrays, names=columns)

    out = _spanned(docs, length).select(*columns, "__spans").mapInArrow(cut, docs.schema)
    out = out.where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``dedup_substrings``: counts, and the sha256 of what stays."""
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
