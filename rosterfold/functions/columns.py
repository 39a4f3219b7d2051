"""Naming and selecting columns whose names are data.

Survey columns carry dots, percent signs, spaces and hyphens, so every name
that goes into an expression is quoted. Expressions are SQL text throughout
the library: a report has hundreds of columns, and text costs the driver one
parse per column where nested ``Column`` calls cost one call per operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """``name`` as a backtick-quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(expression: str, name: str) -> str:
    return f"{expression} AS {quoted(name)}"


def col_q(name: str) -> Column:
    """Column reference that is safe for any name."""
    return F.col(quoted(name))


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """``GROUP BY keys`` with SQL aggregates; no keys give one row."""
    return df.groupBy(*map(quoted, keys)).agg(*map(F.expr, aggregates))


def as_names(names: str | Iterable[str]) -> list[str]:
    """One name or many, as a list without repeats, first occurrence kept."""
    return [names] if isinstance(names, str) else list(dict.fromkeys(names))


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns whose name starts with any prefix, ignoring case."""
    low = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(low)]


def ending_with(df: DataFrame, *suffixes: str) -> list[str]:
    """Columns whose name ends with any suffix, ignoring case."""
    low = tuple(s.lower() for s in suffixes)
    return [c for c in df.columns if c.lower().endswith(low)]


def at_positions(df: DataFrame, positions: Iterable[int]) -> list[str]:
    """Column names at 1-based positions; a position out of range is an error."""
    names = df.columns
    out = []
    for p in positions:
        if not 1 <= p <= len(names):
            raise ValueError(f"position {p} is outside the {len(names)} columns")
        out.append(names[p - 1])
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_columns(df: DataFrame, names: Sequence[str], used_by: str = "") -> None:
    """Fail at plan-building time, naming what is missing and who needs it."""
    present = set(df.columns)
    missing = [n for n in dict.fromkeys(names) if n not in present]
    if missing:
        where = f" needed by {used_by}" if used_by else ""
        raise ValueError(f"missing column(s){where}: {', '.join(missing)}")
