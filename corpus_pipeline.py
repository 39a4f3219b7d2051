"""Documents to packed training sequences: quality, near duplicates, repeated passages, benchmarks, packing.

Each stage works on all that the stage before it kept, and its decisions take
effect: documents that the quality rules reject, or that are toxic by what the ``labels`` teach, go, one document of each group of near
duplicates stays, repeated passages are cut out of the texts, documents that hold a
benchmark item go, and what is left is packed. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterfold.llm import decontaminate, ngram_join, packing, quality, suffix_dedup, toxicity
from rosterfold.llm.common import pin


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    markers = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.passing(docs, "web_v3", markers)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_documents(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("packed", packed),
]

#: Shingle joins, byte strings and token ids are not for SQL: the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
