"""Connected components of a graph in Spark: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import pin, unpin


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b).

    Each round points every node's larger neighbours, then its smaller ones, at
    the smallest; rounds end when nothing changes (after about the logarithm of
    the number of nodes). Edges are written out between rounds, so no lineage grows,
    and those of the round before are deleted.
    """
    edges = pin(_ordered(edges.select("a", "b")))
    before = None
    while True:
        last, edges = edges, pin(_small_star(_large_star(edges)))
        unpin(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return _ordered(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))))
