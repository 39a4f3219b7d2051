"""Bloom filters of the tokens that occur often in a corpus, counted exactly and held in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterfold.llm.common import blob, slices, texts
from rosterfold.llm.words import mix

#: Most bits of a filter.
BITS = 1 << 27
PROBES = 4

_SALTS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def bucket_of(tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 32 bits that tell tokens of a bucket apart."""
    return ((tokens >> np.uint64(40)) % np.uint64(n)).astype(np.int64), tokens.astype(np.uint32)


def packed(values: np.ndarray) -> bytes:
    """Rising 32-bit numbers as planes of the bytes of their steps, which compress well."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def probes(bucket: np.ndarray, low: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of a token in its bucket's slice of a filter of ``size`` bits."""
    token = (bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    out = []
    for salt in _SALTS[: PROBES // 2]:
        h = mix(token ^ salt)
        out += [(h & np.uint64(0xFFFFFFFF)) % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)]
    return [p.astype(np.int64) for p in out]


class Filter:
    """A Bloom filter in one slice of bits for each bucket."""

    def __init__(self, bits: bytes, n: int) -> None:
        self.bits = np.frombuffer(bits, np.uint8)
        self.n, self.size = n, len(bits) * 8 // n

    def has(self, tokens: np.ndarray) -> np.ndarray:
        bucket, low = bucket_of(tokens, self.n)
        out = np.ones(len(tokens), bool)
        for place in probes(bucket, low, self.size):
            place = bucket * self.size + place
            out &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out

    @staticmethod
    def slice(bucket: int, low: np.ndarray, size: int) -> bytes:
        bits = np.zeros(size, bool)
        for place in probes(np.full(len(low), bucket), low, size):
            bits[place] = True
        return np.packbits(bits, bitorder="little").tobytes()


def token_filters(docs: DataFrame, n: int, nbytes: int, tokens_of, above: tuple[int, int]) -> tuple[bytes, bytes]:
    """Filters of the tokens that occur more often than each number of ``above``.

    ``tokens_of`` gives the 64-bit tokens of a list of texts. Counts are taken over all of
    them, with a shuffle of two to five bytes for each different token of a task.
    The first filter has up to ``BITS`` bits, the second an eighth of that.
    """
    bits = 1 << 20
    while bits < min(BITS, 4 * nbytes):
        bits *= 2
    sizes = [max(64, bits // n // 8 * 8), max(64, bits // 8 // n // 8 * 8)]

    def count(batches):
        held, kept = [], 0

        def flush():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            bucket, low = bucket_of(tokens, n)
            order = np.lexsort((low, bucket))
            bucket, low, times = bucket[order], low[order], times[order]
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            rows = [(b, low[s:e], times[s:e]) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
            many = [t > 1 for _, _, t in rows]
            return pa.record_batch(
                {
                    "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                    "once": pa.array([packed(x[~m]) for (_, x, _), m in zip(rows, many, strict=True)], pa.binary()),
                    "more": pa.array([packed(x[m]) for (_, x, _), m in zip(rows, many, strict=True)], pa.binary()),
                    "times": pa.array([blob(t[m].astype("<u4")) for (_, _, t), m in zip(rows, many, strict=True)], pa.binary()),
                }
            )

        for batch in slices(batches):
            held.append(tokens_of(texts(batch.column("text"))))
            kept += len(held[-1])
            if kept > 2_000_000:
                yield flush()
                held, kept = [], 0
        if kept:
            yield flush()

    def slice_of(group):
        bucket = group.column("bucket")[0].as_py()
        once = [unpacked(x) for x in group.column("once").to_pylist()]
        more = [unpacked(x) for x in group.column("more").to_pylist()]
        times = [np.frombuffer(x, "<u4") for x in group.column("times").to_pylist()]
        low = np.concatenate([*once, *more])
        weight = np.concatenate([np.ones(sum(map(len, once)), np.int64), *times]).astype(np.int64)
        order = np.argsort(low)
        low, weight = low[order], weight[order]
        begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total = np.add.reduceat(weight, begin)
        low = low[begin]
        return pa.table(
            {
                "bucket": pa.array([bucket], pa.int32()),
                "first": pa.array([Filter.slice(bucket, low[total > above[0]], sizes[0])], pa.binary()),
                "second": pa.array([Filter.slice(bucket, low[total > above[1]], sizes[1])], pa.binary()),
            }
        )

    slices_ = (
        docs.select("text")
        .mapInArrow(count, "bucket int, once binary, more binary, times binary")
        .groupBy("bucket")
        .applyInArrow(slice_of, "bucket int, first binary, second binary")
        .collect()
    )
    out = []
    for name, size in zip(("first", "second"), sizes, strict=True):
        whole = bytearray(n * size // 8)
        for row in slices_:
            whole[row.bucket * size // 8 : (row.bucket + 1) * size // 8] = row[name]
        out.append(bytes(whole))
    return out[0], out[1]


def member_filter(tokens: DataFrame, n: int, nbytes: int) -> tuple[bytes, int]:
    """A filter (bits, number of slices) of a column ``token`` of 64-bit numbers; its size follows ``nbytes`` up to an eighth of ``BITS``."""
    bits = 1 << 20
    while bits < min(BITS >> 3, nbytes // 16):
        bits *= 2
    size = max(64, bits // n // 8 * 8)

    def deal(batches):
        for batch in batches:
            token = batch.column("token").to_numpy().view(np.uint64)
            yield pa.record_batch({"bucket": pa.array(bucket_of(mix(token), n)[0], pa.int32()), "token": batch.column("token")})

    def slice_of(group):
        bucket = group.column("bucket")[0].as_py()
        low = bucket_of(mix(group.column("token").to_numpy().view(np.uint64)), n)[1]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([Filter.slice(bucket, low, size)], pa.binary())})

    whole = bytearray(n * size // 8)
    for row in (
        tokens.mapInArrow(deal, "bucket int, token bigint")
        .groupBy("bucket")
        .applyInArrow(slice_of, "bucket int, bits binary")
        .collect()
    ):
        whole[row.bucket * size // 8 : (row.bucket + 1) * size // 8] = row.bits
    return bytes(whole), n
