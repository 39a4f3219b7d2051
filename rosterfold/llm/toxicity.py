"""Toxic texts by markers learned from labels, in every language that the labels hold.

A feature is a whole word or the first 4 to 8 bytes of one, lower-cased, as a 64-bit hash;
words are stretches of letters. ``fit`` counts in how many toxic and in how many
other labelled documents each feature stands. A feature is a marker if at least
``SUPPORT`` toxic documents have it and its rate among them is ``LIFT`` times that among the others
(one more document is added to these). A word is toxic if one of its features is a marker.

``fit`` reads ``FITTED`` labelled documents at most, those with the least hashes of their ids: up to half of
them toxic, the others not. With fewer than ``SUPPORT`` toxic documents of a language, words that are only in these
get no markers. Scripts without blanks between words have only the beginnings of their stretches as features.

A document with any toxic label is toxic. Labels with a null id or value are not used, nor are ids without a document.
Null and empty texts have no features. Rows that repeat count each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import prepare, slices, texts
from rosterfold.llm.words import joined, mix, prefix_hashes, runs, span_hashes

FITTED = 1 << 15
SUPPORT = 5
LIFT = 10

PREFIXES = (4, 5, 6, 7, 8)

_WHOLE = np.uint64(0x51ED270B7F4A7C15)


def features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its text, and its features (one column for each kind; 0 for a beginning longer than the word)."""
    data, first, last = joined(found)
    capital = (data >= 65) & (data <= 90)
    after = np.concatenate(([0], data[:-1])) == 0xC3
    capital |= after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = data + capital.astype(np.uint8) * np.uint8(32)
    starts, ends = runs(((small >= 97) & (small <= 122)) | (data >= 0x80))
    owner = np.repeat(np.arange(len(found)), last - first + 1)[starts]
    sums = prefix_hashes(small)
    columns = [mix(span_hashes(sums, starts, ends) ^ _WHOLE)]
    for k in PREFIXES:
        columns.append(np.where(starts + k <= ends, span_hashes(sums, starts, np.minimum(starts + k, ends)), np.uint64(0)))
    return owner, np.stack(columns, axis=1)


def count_toxic(found: list[bytes], markers: np.ndarray) -> np.ndarray:
    """Toxic words of each text; ``markers`` are sorted."""
    owner, keys = features(found)
    if not len(markers):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(markers, keys), len(markers) - 1)
    toxic = (markers[at] == keys).any(axis=1)
    return np.bincount(owner[toxic], minlength=len(found))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The sorted markers."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [
        np.sort(np.array([r.doc_id for r in known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED // 2).collect()], np.int64))
        for side in ("toxic > 0", "toxic <= 0")
    ]
    if not len(chosen[0]):
        return np.zeros(0, np.uint64)
    ids = spark.sparkContext.broadcast(chosen)

    def has(batch):
        for batch in slices(batch):
            column = batch.column("doc_id")
            number = column.fill_null(0).to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            toxic, clean = (np.isin(number, x) & valid for x in ids.value)
            some = toxic | clean
            if not some.any():
                continue
            toxic = toxic[some]
            owner, keys = features(texts(batch.column("text").filter(pa.array(some))))
            order = np.argsort(keys, axis=None, kind="stable")
            key, of = keys.ravel()[order], np.repeat(owner, keys.shape[1])[order]
            # once for each document: of equal keys the owners are in order, as the sort is stable
            new = (key != 0) & np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))[: len(key)]
            key, of = key[new], of[new]
            if not len(key):
                continue
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(head, len(key)))
            bad = np.add.reduceat(toxic[of].astype(np.int64), head)
            yield pa.record_batch({"key": pa.array(key[head].view(np.int64)), "bad": pa.array(bad), "good": pa.array(n - bad)})

    counts = docs.select("doc_id", "text").mapInArrow(has, "key bigint, bad bigint, good bigint")
    counts = counts.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n_bad, n_good = max(1, len(chosen[0])), max(1, len(chosen[1]))
    rows = counts.where(f"bad >= {SUPPORT} AND bad * {n_good} > {LIFT} * (good + 1) * {n_bad}").select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))
