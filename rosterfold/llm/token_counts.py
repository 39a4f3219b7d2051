"""Token counts of whole texts; huge ones are encoded as overlapping chunks and spliced.

A text of more than ``chunk`` characters is cut into chunks that reach ``overlap``
characters into each neighbour. Each chunk is encoded on its own, with offsets,
on whatever task Spark deals it to. Two neighbours are spliced at the first place
in their overlap where both start a pre-token. That place is proven stable: a
byte-level BPE never merges across pre-tokens, its pattern reads from left to
right, so what follows a common start is the same in both, and what precedes it
depends on no more characters than the longest added token or contraction has, which both can see.
Where the overlap holds no such place, the document is encoded again with chunk
and overlap doubled, in the end as one chunk.

Null texts count as empty; empty texts have no tokens; rows that repeat give
results that repeat; null ids stay; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterfold.llm.common import pin, prepare, slices, texts
from rosterfold.llm.encoding import encoder

CHUNK = 1 << 16
OVERLAP = 1 << 10

_PLACES = "array<struct<at:bigint,before:bigint>>"


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), n_chunks."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("a chunk must be longer than both its overlaps")
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    huge = F.char_length("text") > chunk
    short = rows.where(~huge).mapInArrow(
        lambda batches: _count(batches, vocabulary), "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chunks int"
    )
    left = pin(
        rows.where(huge)
        .groupBy("doc_id", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    done = [short]
    while left.take(1):
        spliced = pin(splice(encode_chunks(left, vocabulary, chunk, overlap)))
        whole = spliced.where("n_tokens IS NOT NULL")
        done.append(
            left.join(whole, "row").select(
                "doc_id",
                F.octet_length("text").cast("bigint").alias("n_bytes"),
                "n_tokens",
                "n_chunks",
                F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
            ).drop("copy")
        )
        left = pin(left.join(whole, "row", "left_anti"))
        chunk, overlap = 2 * chunk, 2 * overlap
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _count(batches, vocabulary: str):
    own = encoder(vocabulary)
    for batch in slices(batches):
        found = texts(batch.column("text"))
        split = [own.spans(t.decode()) for t in found]
        flat = own.counts([p for s in split for p in s])
        totals, at = [], 0
        for s in split:
            totals.append(sum(flat[at : at + len(s)]))
            at += len(s)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in found], pa.int64()),
                "n_tokens": pa.array(totals, pa.int64()),
                "n_chunks": pa.array([1] * len(found), pa.int32()),
            }
        )


def encode_chunks(rows: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk: the places of its left and right overlap where a pre-token starts, with the tokens before."""

    def cut(batches):
        for batch in slices(batches, 16):
            for row, text in zip(batch.column("row").to_pylist(), texts(batch.column("text")), strict=True):
                text = text.decode()
                for k in range(0, len(text), chunk):
                    start, end = max(0, k - overlap), min(len(text), k + chunk + overlap)
                    yield pa.record_batch(
                        {
                            "row": pa.array([row], pa.int64()),
                            "k": pa.array([k // chunk], pa.int64()),
                            "start": pa.array([start], pa.int64()),
                            "last": pa.array([k + chunk >= len(text)]),
                            "part": pa.array([text[start:end]]),
                        }
                    )

    def encode(batches):
        own = encoder(vocabulary)
        for batch in slices(batches, 8):
            lefts, rights = [], []
            for part, start, k, last in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "k", "last")), strict=True):
                places, total = pre_tokens(own, part)
                cut_at, end = (k * chunk, (k + 1) * chunk), start + len(part)
                seen = [(start + p, n) for p, n in places[1:] if start + p <= end - own.reach]
                lefts.append([{"at": 0, "before": 0}] if k == 0 else _within(seen, cut_at[0] - overlap, cut_at[0] + overlap))
                rights.append([{"at": end, "before": total}] if last else _within(seen, cut_at[1] - overlap, cut_at[1] + overlap))
            places = pa.list_(pa.struct({"at": pa.int64(), "before": pa.int64()}))
            yield pa.record_batch(
                {
                    "row": batch.column("row"),
                    "k": batch.column("k"),
                    "last": batch.column("last"),
                    "lefts": pa.array(lefts, places),
                    "rights": pa.array(rights, places),
                }
            )

    chunks = rows.mapInArrow(cut, "row bigint, k bigint, start bigint, last boolean, part string")
    return chunks.repartition("row", "k").mapInArrow(
        encode, f"row bigint, k bigint, last boolean, lefts {_PLACES}, rights {_PLACES}"
    )


def _within(places, low: int, high: int) -> list[dict]:
    return [{"at": p, "before": n} for p, n in places if low <= p < high]


def pre_tokens(own, text: str) -> tuple[list[tuple[int, int]], int]:
    """Where pre-tokens start (behind their white space) with the tokens before, and all tokens."""
    places, total, at = [], 0, 0
    pieces = own.spans(text)
    if len(pieces) != 1 or pieces[0] != text:
        for piece, n in zip(pieces, own.counts(pieces), strict=True):
            inside = piece.lstrip("\t\n\x0b\x0c\r ")
            if inside:
                places.append((at + len(piece) - len(inside), total))
            at += len(piece)
            total += n
        return places, total
    found = own.library.encode(text, add_special_tokens=False)
    word = None
    for n, (here, (start, end)) in enumerate(zip(found.word_ids, found.offsets, strict=True)):
        if here != word and end > start and not text[start].isspace():
            places.append((start, n))
        word = here
    return places, len(found.ids)


def splice(chunks: DataFrame) -> DataFrame:
    """row, n_chunks, n_tokens: null where two neighbours share no place."""
    order = Window.partitionBy("row").orderBy("k")
    next_lefts = F.lead("lefts").over(order)
    common = F.expr(
        "CASE WHEN last THEN get(rights, 0).at ELSE array_min(array_intersect(transform(rights, x -> x.at), transform(next_lefts, x -> x.at))) END"
    )
    placed = (
        chunks.withColumn("next_lefts", next_lefts)
        .withColumn("to", common)
        .withColumn("from", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("to").over(order)))
    )
    tokens = F.expr(
        "get(filter(rights, x -> x.at = `to`), 0).before - get(filter(lefts, x -> x.at = `from`), 0).before"
    )
    return placed.groupBy("row").agg(
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        F.when(F.count(tokens) == F.count(F.lit(1)), F.sum(tokens)).alias("n_tokens"),
    )
