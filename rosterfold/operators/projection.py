"""Projections that work on column names and positions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import (
    as_names,
    at_positions,
    ending_with,
    named,
    numeric_columns,
    quoted,
    require_columns,
    starting_with,
)
from rosterfold.functions.numbers import to_number, to_text


def named_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in the order given, each once."""
    require_columns(df, columns)
    return df.selectExpr(*map(quoted, as_names(columns)))


def positional_projection(
    df: DataFrame, key: str, positions: Iterable[int] | None = None
) -> DataFrame:
    """The key first, then columns at 1-based positions (default: all but the first)."""
    require_columns(df, [key])
    if positions is None:
        positions = range(2, len(df.columns) + 1)
    return named_projection(df, [key, *at_positions(df, positions)])


def drop_by_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    gone = set(starting_with(df, *prefixes))
    return named_projection(df, [c for c in df.columns if c not in gone])


def select_by_suffix(df: DataFrame, *suffixes: str, keep: Sequence[str] = ()) -> DataFrame:
    return named_projection(df, [*keep, *ending_with(df, *suffixes)])


def select_rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``{new: old}``, in order; other columns are dropped."""
    require_columns(df, list(columns.values()))
    return df.selectExpr(*[named(quoted(old), new) for new, old in columns.items()])


def suffix_columns(df: DataFrame, suffix: str, key: str | Sequence[str]) -> DataFrame:
    """Add a suffix to every column name but the key."""
    keys = set(as_names(key))
    return select_rename(df, {c if c in keys else c + suffix: c for c in df.columns})


def computed_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns by SQL expression, each of which may use the ones before it."""
    for name, expression in columns.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def round_numeric(df: DataFrame, digits: int = 2, skip: Sequence[str] = ()) -> DataFrame:
    """Round every numeric column that is not skipped."""
    chosen = set(numeric_columns(df)) - set(skip)
    return df.selectExpr(
        *[
            named(f"round({quoted(c)}, {digits})", c) if c in chosen else quoted(c)
            for c in df.columns
        ]
    )


def coerce_types(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """Listed columns to text, every other column to double, bad numbers to NULL."""
    text = set(text_columns)
    return df.selectExpr(
        *[
            named((to_text if f.name in text else to_number)(quoted(f.name), f.dataType), f.name)
            for f in df.schema.fields
        ]
    )
