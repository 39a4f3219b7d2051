"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterfold.llm import (
    context_tree,
    cover_tree,
    decontaminate,
    importance,
    language,
    licenses,
    merkle,
    ngram_join,
    packing,
    quality,
    records,
    sql,
    suffix_dedup,
    token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def _quality_sql() -> str:
    """The ledger's columns from lists of words and lines."""
    word, letter = r"[^\x20\x09-\x0D]+", r"[A-ZÀ-ÖØ-Þa-zß-öø-ÿ\x{100}-\x{10FFFF}]"
    insults = ", ".join(f"'{w}'" for w in quality.INSULTS)
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))
    fails = {p: " OR ".join(f"({quality.RULES[r]})" for r in rules) for p, rules in quality.POLICIES.items()}
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (SELECT *, regexp_extract_all(t, '{word}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM texts),
    windows AS (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
    counted AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows),
    repeated AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words
        FROM counted, (VALUES (0), (1), (2)) AS near(k) WHERE n > 1 GROUP BY row),
    measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(regexp_replace(t, '[^a-zß-öø-ÿ]', '', 'g')) AS BIGINT) AS n_lower,
        CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word,
        CAST(len(list_filter(w, lambda x: regexp_matches(x, '{letter}'))) AS BIGINT) AS n_letter_words,
        CAST(len(list_filter(regexp_extract_all(lower(t), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+'), lambda x: x IN ({insults}))) AS BIGINT) AS n_insults
        FROM cut LEFT JOIN repeated USING (row))
    SELECT *, CAST({bits} AS BIGINT) AS failed, ({fails["base_v1"]}) AS base_failed, NOT ({fails["web_v2"]}) AS kept
    FROM measured"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"))
    measures = [F.col(m) for m in quality.MEASURES]
    return found.select(
        "doc_id", *measures, "failed", (~quality.kept("base_v1")).alias("base_failed"), quality.kept("web_v2").alias("kept")
    )


@query
def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = records.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return records.read(spark, files)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).drop("langs")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.digest(merkle.manifest(docs, {"text": merkle.without_line_feeds(docs)}))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLE["op5_quality_rules"] = _quality_sql()
ORACLE["op11_merkle_manifest"] = sql.MANIFEST
ORACLE["op12_importance_resampling"] = sql.RESAMPLING
ORACLE["op13_cover_tree"] = sql.VECTORS
ORACLE["op3_ngram_join"] = sql.SHINGLES
