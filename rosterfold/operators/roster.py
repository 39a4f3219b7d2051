"""Keeping the organisations of a roster, and dropping keys that are no keys."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import col_q, literal, named, quoted

# Either literal ids, or a DataFrame whose first column holds the ids.
Roster = Union[Iterable, DataFrame]

# Literal ids travel inside the plan, so their number is bounded.
MAX_LITERAL_IDS = 10_000


def literal_ids(roster: Iterable) -> list:
    ids = [i for i in dict.fromkeys(roster) if i is not None]
    if len(ids) > MAX_LITERAL_IDS:
        raise ValueError(f"{len(ids)} literal ids; pass a roster DataFrame beyond {MAX_LITERAL_IDS}")
    return ids


def _ids(roster: DataFrame, key: str) -> DataFrame:
    return roster.selectExpr(named(quoted(roster.columns[0]), key))


def roster_filter(df: DataFrame, key: str, roster: Roster) -> DataFrame:
    """Rows whose key is on the roster; repeated ids never multiply rows.

    Literal ids become an ``IN`` predicate that reaches the scan. A roster
    DataFrame becomes a semi join without a hint: Spark broadcasts it when its
    measured size is under the threshold and shuffles (with AQE skew handling)
    when it is not.
    """
    if isinstance(roster, DataFrame):
        return df.join(_ids(roster, key), key, "left_semi")
    return df.where(col_q(key).isin(literal_ids(roster)))


def roster_flag(df: DataFrame, key: str, roster: Roster, name: str = "on_roster") -> DataFrame:
    """All rows, with a boolean that says whether the key is on the roster."""
    if isinstance(roster, DataFrame):
        ids = _ids(roster, key).distinct().withColumn(name, F.lit(True))
        return df.join(ids, key, "left").withColumn(name, F.expr(f"coalesce({quoted(name)}, false)"))
    on_roster = col_q(key).isin(literal_ids(roster))
    return df.withColumn(name, F.coalesce(on_roster, F.lit(False)))


def key_cleanup(df: DataFrame, key: str, placeholder: str = "^-,$") -> DataFrame:
    """Drop rows with a missing or placeholder key."""
    k = quoted(key)
    return df.where(f"{k} IS NOT NULL AND NOT {k} RLIKE {literal(placeholder)}")


def in_years(year: str, *years: str) -> str:
    """SQL test on a year column; the year is text, so it is compared as text."""
    return f"{quoted(year)} IN ({', '.join(literal(str(y)) for y in years)})"


def period_filter(df: DataFrame, year: str, *years: str) -> DataFrame:
    """Rows of the given years."""
    return df.where(in_years(year, *years))
