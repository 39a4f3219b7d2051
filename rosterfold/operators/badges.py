"""Yearly badge sheets: merge across years, count badges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from rosterfold.functions.columns import ending_with
from rosterfold.operators.measures import Measure, summarise, yes_cells, yes_rows
from rosterfold.operators.merge import outer_merge
from rosterfold.operators.projection import drop_by_prefix, suffix_columns


def merge_badges(
    sheets: Mapping[str, DataFrame],
    key: str,
    drop_prefixes: Sequence[str] = ("HC Type",),
    keep_null_key: bool = True,
    unique_keys: bool | None = True,
) -> DataFrame:
    """Outer merge of ``{year: sheet}``; value columns get ``_<year>`` appended.

    Dropping columns by prefix first keeps them out of the shuffle. NULL keys match
    each other unless ``keep_null_key`` is off. A key that a sheet repeats is an
    error; with ``unique_keys=False`` full joins are chained, where repeated keys,
    NULL among them, multiply; with ``unique_keys=None`` that is done for those keys alone.
    """
    renamed = {
        year: suffix_columns(drop_by_prefix(sheet, *drop_prefixes), f"_{year}", key)
        for year, sheet in sheets.items()
    }
    return outer_merge(renamed, key, keep_null_key=keep_null_key, unique_keys=unique_keys)


def badge_count(df: DataFrame, columns: Sequence[str], yes: str = "Yes") -> DataFrame:
    """One row: how many organisations hold each badge."""
    return summarise(df, [], [yes_cells(c, [c], yes) for c in columns])


def _by_year(df: DataFrame, years: Sequence[str], prefix: str, make) -> list[Measure]:
    return [make(f"{prefix}{y}", ending_with(df, str(y))) for y in years]


def badge_cells(df: DataFrame, years: Sequence[str], prefix: str = "total_badges_") -> DataFrame:
    """One row: Yes cells over every column of each year, several per organisation."""
    return summarise(df, [], _by_year(df, years, prefix, yes_cells))


def badge_holders(df: DataFrame, years: Sequence[str], prefix: str = "holders_") -> DataFrame:
    """One row: organisations with at least one Yes in each year."""
    return summarise(df, [], _by_year(df, years, prefix, yes_rows))
