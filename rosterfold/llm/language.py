"""Language identification of texts that may mix languages.

Training counts hashed byte trigrams of lower-cased words for each language, over
all labelled rows. A text is then seen as a mixture: each word comes from one of
the languages with the text's own proportions, and a word's likelihood in a
language is the product of its trigrams'. Expectation-maximisation estimates
the proportions. The set of languages is the one with the best log likelihood less a
penalty for each language (half the logarithm of the number of words, times
``PENALTY``): sets are the most frequent one, two, ... languages of the full mixture.

The model has ``SLOTS`` numbers for each language, whatever the corpus; it is what
the driver holds and tasks are sent. Trigrams that share a slot share a count.

Null texts and texts without a letter are ``und`` with score 0. Rows without
``lang`` are not learned from. Without any labelled row every text is ``und``. Rows
that repeat count each; null ids are never held out; ties go to the language first by
name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import prepare, remainders, slices, texts
from rosterfold.llm.words import joined, runs

SLOTS = 1 << 16
SMOOTHING = 0.5
PENALTY = 2.0
FULL_STEPS, SET_STEPS = 6, 3

#: Largest set of languages that a text is tried with.
MOST = 4

UNKNOWN = "und"


def trigrams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of the trigram around each letter byte, the first of them in each word, and each word's text."""
    data, first, last = joined(found)
    owner = np.repeat(np.arange(len(found)), last - first + 1)
    wide = (np.concatenate(([0], data[:-1])) == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = data + (((data >= 65) & (data <= 90)) | wide).astype(np.uint8) * np.uint8(32)
    letter = ((small >= 97) & (small <= 122)) | (data >= 0x80)
    small = np.where(letter, small, np.uint8(32)).astype(np.uint32)
    starts, ends = runs(letter)
    at = np.flatnonzero(letter)
    padded = np.concatenate(([32], small, [32])).astype(np.uint32)
    key = (padded[at] << 16) | (padded[at + 1] << 8) | padded[at + 2]
    slot = ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    sizes = ends - starts
    return slot, np.cumsum(sizes) - sizes, owner[starts]


def train(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """lang, slot, n: trigram counts of each language, over rows whose crc32(doc_id) leaves another remainder."""
    prepare(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            langs[remainders(batch.column("doc_id"), modulus) == held_out] = None
            slot, first, owner = trigrams(texts(batch.column("text")))
            of = np.repeat(owner, np.diff(np.append(first, len(slot))))
            for lang in {x for x in langs if x is not None}:
                counted = np.bincount(slot[(langs == lang)[of]], minlength=SLOTS)
                sums[lang] = sums.get(lang, 0) + counted
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.record_batch(
                {"lang": pa.array([lang] * len(some), pa.string()), "slot": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())}
            )

    counted = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL").mapInArrow(
        count, "lang string, slot int, n bigint"
    )
    return counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def log_likelihoods(counts) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log p(slot | language) as an array of slots by languages."""
    langs = sorted(counts["lang"].unique())
    table = np.full((SLOTS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["slot"], k] += own["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table.astype(np.float32)


def mixtures(found: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each text (zero outside the chosen set), and which texts have words."""
    n, width = len(found), table.shape[1]
    slot, first, owner = trigrams(found)
    has = np.bincount(owner, minlength=n)
    share = np.zeros((n, width))
    if not len(first) or not width:
        return share, has > 0
    likely = np.add.reduceat(table[slot], first, axis=0)
    top = likely.max(1, keepdims=True)
    likely = np.exp(likely - top)
    texts_, begin = np.unique(owner, return_index=True)
    index = np.repeat(np.arange(len(texts_)), has[texts_])
    words = has[texts_].astype(float)

    def climb(p: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            part = likely * p[index].astype(np.float32)
            part /= part.sum(1, keepdims=True) + 1e-30
            p = np.add.reduceat(part, begin, axis=0) / words[:, None]
        return p

    full = climb(np.full((len(texts_), width), 1 / width), FULL_STEPS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(texts_), -np.inf), full
    for k in range(1, min(MOST, width) + 1):
        p = np.where(rank < k, full, 0) + 1e-12 * (rank < k)
        p /= p.sum(1, keepdims=True)
        p = climb(p, SET_STEPS if k > 1 else 0)
        fit = np.add.reduceat(np.log((likely * p[index]).sum(1) + 1e-30), begin)
        fit -= PENALTY * k * np.log(words + 1) / 2
        better = fit > best
        best = np.where(better, fit, best)
        chosen = np.where(better[:, None], p, chosen)
    share[texts_] = chosen
    return share, has > 0


def identify(docs: DataFrame, counts: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), langs (the chosen set with proportions)."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(log_likelihoods(counts.toPandas()))

    def label(batches):
        langs, table = model.value
        for batch in slices(batches):
            found = texts(batch.column("text"))
            share, has = mixtures(found, table)
            for k in np.flatnonzero(has):  # bytes beyond ASCII need not be letters
                has[k] = any(map(str.isalpha, found[k][:64].decode(errors="ignore"))) or any(map(str.isalpha, found[k].decode()))
            has &= len(langs) > 0
            top = share.argmax(1) if len(langs) else np.zeros(len(found), int)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": pa.array(remainders(batch.column("doc_id"), modulus) == held_out),
                    "lang_pred": pa.array([langs[t] if h else UNKNOWN for t, h in zip(top, has, strict=True)]),
                    "score": pa.array([float(min(1, share[i, t])) if h else 0.0 for i, (t, h) in enumerate(zip(top, has, strict=True))]),
                    "langs": pa.array(
                        [
                            sorted((langs[j], round(float(share[i, j]), 4)) for j in np.flatnonzero(share[i] > 0)) if h else []
                            for i, h in enumerate(has)
                        ],
                        pa.map_(pa.string(), pa.float64()),
                    ),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        label, "doc_id bigint, held_out boolean, lang_pred string, score double, langs map<string,double>"
    )
