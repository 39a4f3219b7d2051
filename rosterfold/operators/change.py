"""Years to columns, and change between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rosterfold.functions.columns import as_names, group_by, literal, named, quoted
from rosterfold.functions.labels import signed_label
from rosterfold.functions.numbers import pct
from rosterfold.operators.roster import period_filter


def pivot_years(
    df: DataFrame,
    key: str | Sequence[str],
    year: str,
    value: str,
    years: Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """One row per key, one column per year; NULL where the key lacks the year.

    The input has one row per key and year; a second one is an error. Years are given, not discovered, so
    there is no extra job, and one conditional aggregation per year needs only
    one shuffle.
    """

    def cell(y: str) -> str:
        of_year = f"{quoted(year)} = {literal(str(y))}"
        twice = f"raise_error({literal(f'more than one row of a key in {y}')})"
        only = f"max(IF({of_year}, {quoted(value)}, NULL))"
        return f"IF(count_if({of_year}) > 1, {twice}, {only})"

    cells = [named(cell(y), f"{prefix}{y}") for y in years]
    return group_by(period_filter(df, year, *years), as_names(key), cells)


def growth_pct(old: str, new: str, digits: int = 1) -> str:
    """Relative change in percent, as SQL text."""
    return pct(f"{new} - {old}", old, digits)


def change_points(old: str, new: str, digits: int = 1) -> str:
    """Difference of two ratios in percentage points, as SQL text."""
    return f"round(({new} - {old}) * 100, {digits})"


def growth_label(change: str, since: str, na_text: str | None = None) -> str:
    return signed_label(change, f"% since {since}", na_text=na_text)


def points_label(change: str, old: str, new: str, na_text: str | None = None) -> str:
    return signed_label(change, f" pts ({old}-{new})", na_text=na_text)
