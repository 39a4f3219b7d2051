"""Target-distribution importance resampling over hashed word n-grams.

Texts are bags of features: all runs of 1 to 3 words, each hashed into a bucket by its
CRC-32. Bucket counts over the corpus and over the target texts give each bucket a gain (how
much likelier it is in the target); a document's weight is the sum of its features' gains,
and drawing the highest weights plus Gumbel noise is sampling without replacement in
proportion to their exponentials.

A CRC is linear but for a constant that the length alone decides: the register of a feature
is the XOR of what each byte contributes at its distance from the feature's end. A table
holds these contributions for ``REACH`` distances; the bytes of all features of a batch are
looked up at once and ``bitwise_xor.reduceat`` folds them by feature. Features longer than
``REACH`` bytes are folded in blocks: the register so far is moved on by a whole block of
bytes before the next block's contributions are added.

Counts are summed for each task first and there are ``buckets`` of them, whatever the corpus;
gains are that many numbers. Texts beyond ``PIECE`` bytes are worked on in pieces that share two words, so
memory follows the piece, or the longest word.

Null and empty texts have no features, weight 0, and are never drawn. A null ``doc_id``
counts as an empty one in the noise, and comes last among ties. Rows that repeat are each scored,
and drawn one by one; which of two equal rows comes first does not matter. Only ``doc_id`` and
``text`` are read, so other columns may have any name. An empty corpus gives no rows; an empty target
only moves all gains alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import pin, prepare, slices, texts
from rosterfold.llm.ranks import ranked
from rosterfold.llm.words import joined, lower, runs

#: Words of the longest feature.
LONGEST = 3

#: Distances from a feature's end that the table of contributions holds.
REACH = 64

#: Bytes of text worked on at once.
PIECE = 1 << 20

#: Blocks of features looked up at once; what they hold stays in a core's cache.
_BLOCKS = 1 << 12
_STEPS = np.arange(_BLOCKS * REACH)
_ROWS = _STEPS << 8


def _moved(registers: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after ``REACH`` further bytes, by their four bytes."""
    out = table[0][registers & 255]
    for k in range(1, 4):
        out ^= table[k][(registers >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from the end, and where ``REACH`` more bytes move a register."""
    last = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    reach = np.empty((REACH, 256), np.uint32)
    reach[0] = last
    for d in range(1, REACH):
        reach[d] = last[reach[d - 1] & 255] ^ (reach[d - 1] >> np.uint32(8))
    moved = np.empty((4, 256), np.uint32)
    for k in range(4):
        moved[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(REACH):
            moved[k] = last[moved[k] & 255] ^ (moved[k] >> np.uint32(8))
    return reach, moved


_REACH, _MOVED = _tables()
_FLAT = _REACH.ravel()

#: CRC-32 of so many zero bytes: the constant of each length.
_LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(1024)], np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    out = _LENGTHS[np.minimum(lengths, len(_LENGTHS) - 1)]
    for n in np.unique(lengths[lengths >= len(_LENGTHS)]).tolist():
        crc, zeros = 0, bytes(min(n, 1 << 16))
        for at in range(0, n, 1 << 16):
            crc = zlib.crc32(zeros[: n - at], crc)
        out[lengths == n] = crc
    return out


def _contributions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of the bytes of each block of 1 to ``REACH`` bytes."""
    out = np.empty(len(starts), np.uint32)
    for at in range(0, len(starts), _BLOCKS):
        first, last = starts[at : at + _BLOCKS], ends[at : at + _BLOCKS]
        base = int(first.min())
        sizes = last - first
        begin = np.cumsum(sizes) - sizes
        steps = _STEPS[: int(sizes.sum())]
        near = data[base : int(last.max())]
        # a byte's row in the flat table is its distance from the end, 256 entries each
        row = np.repeat((begin + sizes - 1) << 8, sizes)
        row -= _ROWS[: len(steps)]
        places = np.repeat(first - base - begin, sizes)
        places += steps
        row += near.take(places, mode="clip")
        out[at : at + _BLOCKS] = np.bitwise_xor.reduceat(_FLAT.take(row, mode="clip"), begin)
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of one byte or more."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    sizes = ends - starts
    registers = np.empty(len(starts), np.uint32)
    short = sizes <= REACH
    registers[short] = _contributions(data, starts[short], ends[short])
    long = np.flatnonzero(~short)
    if len(long):
        blocks = -(-sizes[long] // REACH)
        base = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(long)), blocks)
        number = np.arange(int(blocks.sum())) - base[owner]  # from the end: block 0 is the last
        stop = ends[long][owner] - number * REACH
        found = _contributions(data, np.maximum(stop - REACH, starts[long][owner]), stop)
        folded = np.zeros(len(long), np.uint32)
        for k in range(int(blocks.max()) - 1, -1, -1):
            at = np.flatnonzero(blocks > k)
            folded[at] = _moved(folded[at], _MOVED) ^ found[base[at] + k]
        registers[long] = folded
    return registers ^ _constants(sizes)


def _is_word(data: np.ndarray) -> np.ndarray:
    return ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)


def _pieces(text: bytes, limit: int = PIECE):
    """(piece, words at its start that the piece before it ended with) of a text, cut between words."""
    if len(text) <= limit:
        yield text, 0
        return
    data = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(~_is_word(lower(data)))
    start, carried, known = 0, b"", 0
    while start < len(text):
        k = int(np.searchsorted(gaps, start + limit))
        end = int(gaps[k]) if start + limit < len(text) and k < len(gaps) else len(text)
        piece = carried + text[start:end]
        yield piece, known
        first, last = runs(_is_word(lower(np.frombuffer(piece, np.uint8))))
        keep = min(LONGEST - 1, len(first))
        carried = b"".join(piece[i:j] + b" " for i, j in zip(first[len(first) - keep :], last[len(last) - keep :], strict=True))
        start, known = end, keep


def features(pieces: list[tuple[bytes, int]], buckets: int):
    """(number of the piece, bucket) of all features, by length, and the number of words of each piece.

    Features that lie within the words a piece took over are left out, as are those words.
    """
    data, starts, _ = joined([p for p, _ in pieces])
    data = lower(data)
    inside = _is_word(data)
    after = ~inside
    after[0] = False
    after[1:] &= inside[:-1]
    kept = inside | after
    plain = np.where(inside, data, np.uint8(32))[kept]
    first, last = runs(inside[kept])
    owner = np.searchsorted(starts, np.flatnonzero(kept)[first], side="right") - 1
    words = np.bincount(owner, minlength=len(pieces))
    known = np.array([k for _, k in pieces], np.int64)
    place = np.arange(len(first)) - (np.cumsum(words) - words)[owner]
    found = []
    for n in range(1, LONGEST + 1):
        k = len(first) - n + 1
        if k <= 0:
            break
        good = np.flatnonzero((owner[:k] == owner[n - 1 :]) & (place[n - 1 :] >= known[owner[:k]]))
        crcs = span_crcs(plain, first[good], last[good + n - 1])
        found.append((owner[good], crcs.astype(np.int64) % buckets))
    return found, words - known


def _batches(batches, column: str):
    """Record batches with their rows' pieces and each piece's row, a bounded number of bytes at once."""
    for batch in slices(batches, limit=PIECE):
        held: list[tuple[bytes, int]] = []
        rows: list[int] = []
        size = 0
        for row, text in enumerate(texts(batch.column(column))):
            for piece in _pieces(text):
                held.append(piece)
                rows.append(row)
                size += len(piece[0])
                if size >= PIECE:
                    yield batch, held, np.array(rows), False
                    held, rows, size = [], [], 0
        yield batch, held, np.array(rows, np.int64), True


def bucket_counts(texts_: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all rows' ``text``."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, pieces, _, _ in _batches(batches, "text"):
            if pieces:
                for _, numbers in features(pieces, buckets)[0]:
                    total += np.bincount(numbers, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts_.select("text").mapInArrow(count, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket: a thousand times the log of its smoothed share in the target over that in ``docs``."""
    both = (
        docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs, buckets).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    counts = pin(both)
    totals = counts.agg(F.sum("s"), F.sum("t")).first()
    share = f"((t + 1D) * ({totals[0]}D + {buckets}D)) / ((s + 1D) * ({totals[1]}D + {buckets}D))"
    return [r.gain for r in counts.selectExpr("bucket", f"floor(1000D * ln({share})) AS gain").orderBy("bucket").collect()]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    table = np.array(gain, np.int64)

    def weigh(batches):
        held = None
        for batch, pieces, rows, done in _batches(batches, "text"):
            if held is None:
                held = np.zeros((3, batch.num_rows), np.int64)
            if pieces:
                found, words = features(pieces, len(table))
                np.add.at(held[0], rows, words)
                for owner, numbers in found:
                    for k, each in ((1, np.ones(len(numbers), np.int64)), (2, table[numbers])):
                        sums = np.zeros(len(pieces), np.int64)
                        np.add.at(sums, owner, each)
                        np.add.at(held[k], rows, sums)
            if done:
                columns = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, held)]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])
                held = None

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    return docs.select("doc_id", "text").mapInArrow(weigh, schema)


def noise(doc_id: str = "doc_id", seed: int = 42) -> str:
    """SQL of a thousand times a Gumbel number that the seed and the id decide."""
    digits = f"substring(sha2(concat('{seed}:', coalesce(CAST({doc_id} AS STRING), '')), 256), 1, 8)"
    share = f"(CAST(conv({digits}, 16, 10) AS DOUBLE) + 0.5D) / 4294967296D"
    return f"floor(-1000D * ln(-ln({share})))"


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, buckets: int = 10_000, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every document; ``rank`` is null where it is not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn.
    """
    prepare(docs.sparkSession)
    scored = weights(docs, gains(docs, target, buckets)).selectExpr(
        "*", f"weight + {noise(seed=seed)} AS score", "monotonically_increasing_id() AS __row"
    )
    scored = pin(scored)
    long = F.col("n_words") >= least_words
    drawn = scored.where(long).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row").asc()]
    ordered = ranked(scored.where(long), order)
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    chosen = ordered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~long).withColumn("rank", F.lit(None).cast("bigint"))
    return chosen.select(*out).unionByName(others.select(*out))
