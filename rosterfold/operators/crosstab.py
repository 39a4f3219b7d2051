"""Two-way count tables with totals, row percentages and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import (
    col_q,
    group_by,
    literal,
    named,
    quoted,
    require_columns,
)
from rosterfold.functions.labels import count_pct_label
from rosterfold.functions.numbers import safe_div

# Column name for NULL cells; more underscores follow where a value has that name.
MISSING = "NA_"


def column_values(df: DataFrame, column: str, limit: int = 10_000) -> list[str | None]:
    """Distinct values of a column as text (None for NULL), most frequent first.

    Runs a job. The values become columns, so more than ``limit`` is an error.
    """
    counts = df.groupBy(col_q(column).cast("string").alias("value")).count()
    found = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values, too many for columns")
    return [r["value"] for r in found]


def crosstab(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence[str | None] | None = None,
    total: str | None = None,
    limit: int = 10_000,
) -> DataFrame:
    """Counts of ``column`` values per ``row`` value, zero where none occur.

    ``values`` are the columns in output order; None counts NULLs, under the name
    ``NA_``. Without ``values`` all are found first, at most ``limit``. With
    ``total`` a column of that name counts every row, listed value or not.

    Rows are counted by row and value first, so that the wide part only sees
    one line for each of these.
    """
    require_columns(df, [row, column], "crosstab")
    if values is None:
        values = column_values(df, column, limit)
    values = list(dict.fromkeys(values))
    missing = MISSING
    while missing in values:
        missing += "_"
    names = [missing if v is None else v for v in values]
    taken = [row, *names, *([] if total is None else [total])]
    clash = sorted({n for n in taken if taken.count(n) > 1})
    if clash:
        raise ValueError(f"column(s) named twice in a crosstab: {', '.join(clash)}")
    counted = df.selectExpr(
        f"{quoted(row)} AS __row", f"CAST({quoted(column)} AS STRING) AS __value"
    ).groupBy("__row", "__value").agg(F.count(F.lit(1)).alias("__n"))
    cells = [
        named(f"sum(IF(__value <=> {'NULL' if v is None else literal(v)}, __n, 0L))", n)
        for v, n in zip(values, names)
    ]
    if total is not None:
        cells.append(named("sum(__n)", total))
    return group_by(counted, ["__row"], cells).withColumnRenamed("__row", row)


def with_row_total(table: DataFrame, row: str, total: str = "Total") -> DataFrame:
    """Add the sum of all counts of a row."""
    cells = " + ".join(quoted(c) for c in table.columns if c != row)
    return table.selectExpr("*", named(cells, total))


def _each_count(table: DataFrame, row: str, make: Callable[[str], str]) -> DataFrame:
    return table.selectExpr(
        quoted(row), *[named(make(quoted(c)), c) for c in table.columns if c != row]
    )


def row_percentages(table: DataFrame, row: str, total: str = "Total") -> DataFrame:
    """Each count as a fraction of its row's total."""
    return _each_count(table, row, lambda n: safe_div(n, quoted(total)))


def count_percent_labels(table: DataFrame, row: str, total: str = "Total") -> DataFrame:
    """Each count as ``n (p%)`` of its row's total."""
    return _each_count(table, row, lambda n: count_pct_label(n, quoted(total)))


def order_by_count(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """Values with their counts, most to least; equal counts by value."""
    counts = group_by(df, [column], [named("count(1)", n)])
    return counts.orderBy(F.desc(n), col_q(column).asc_nulls_last())
