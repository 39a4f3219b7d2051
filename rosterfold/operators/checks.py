"""Row-count checks and ordered report output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rosterfold.functions.columns import as_names, col_q


def row_count_check(df: DataFrame, expected: int | DataFrame) -> DataFrame:
    """One row: rows found, rows expected (a number, or the rows of a DataFrame), match."""
    found = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if isinstance(expected, DataFrame):
        want = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        want = F.lit(expected).cast("bigint")
    return found.withColumn("expected", want).withColumn(
        "as_expected", F.col("n_rows") == F.col("expected")
    )


def assert_row_count(df: DataFrame, expected: int | DataFrame) -> None:
    """Run the check and fail when it does not hold."""
    row = row_count_check(df, expected).first()
    if not row["as_expected"]:
        raise ValueError(f"{row['n_rows']} rows, expected {row['expected']}")


def written_rows(df: DataFrame, write: Callable[[DataFrame], None], expected: int | None = None) -> int:
    """Write ``df`` and return its number of rows, counted by the job that writes it.

    Fails after the write where another number was ``expected``.
    """
    counted = Observation()
    write(df.observe(counted, F.count(F.lit(1)).alias("n_rows")))
    found = counted.get["n_rows"]
    if expected is not None and found != expected:
        raise ValueError(f"{found} rows, expected {expected}")
    return found


def ordered_report(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Ascending by the group keys, NULL groups last; for small final tables."""
    return df.orderBy(*[col_q(k).asc_nulls_last() for k in as_names(by)])
