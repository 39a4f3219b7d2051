"""Writing stacked tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rosterfold.functions.columns import quoted


def write_stacked(df: DataFrame, path: str, year: str = "ReportingYear") -> None:
    """Write the stacked table, one directory per year.

    The rebalance hint lets AQE cut a large year into several files and put
    small years into one, so neither a hot year nor tiny files hurt.
    """
    df.hint("rebalance", quoted(year)).write.mode("overwrite").partitionBy(year).parquet(path)


def write_year(df: DataFrame, path: str, year: str = "ReportingYear") -> None:
    """Replace only the years present in ``df``; other years stay as they are."""
    (
        df.hint("rebalance", quoted(year))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(year)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write one report table."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')  # as the scan reads it
    writer.format(fmt).save(path)
