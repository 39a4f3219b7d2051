"""Declarative measures, computed together in one aggregation.

A report is a list of :class:`Measure`; :func:`summarise` turns the whole list
into a single ``groupBy().agg()``: one scan of the columns used, one partial
aggregation per task and one small shuffle, however many measures there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import (
    as_names,
    col_q,
    group_by,
    literal,
    named,
    quoted,
    require_columns,
)
from rosterfold.functions.numbers import exact_sum, or_zero, row_sum, safe_div, steady_sum
from rosterfold.sources.pinning import pinned

@dataclass(frozen=True)
class Measure:
    """One named aggregate.

    kind        columns                 value
    total       one                     sum, 0 when nothing is reported
    row_total   any number              sum over rows and columns, same zero rule
    mean        one                     unweighted mean, NULL when nothing is reported
    reported    one                     count of non-NULL cells
    suppressed  one                     count of NULL cells
    rows        none                    count of rows
    yes_cells   any number              count of cells equal to ``yes``
    yes_rows    any number              count of rows with at least one such cell
    ratio       part, base, weight      sum(part / base * weight) / sum(weight)
    gap         total, then components  sum(components) - sum(total)

    ``places`` makes sums exact decimals with that many digits; leave it None
    for columns with an unknown number of decimals. A ratio's terms are quotients,
    so ``places`` is for its weights alone; its terms are summed as they are, in units of 2^-62, unless
    ``term_places`` says to how many digits each may be rounded. ``digits`` rounds
    the result. ``strict`` makes a ratio's denominator use only rows that its
    numerator used.
    """

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    places: int | None = None
    digits: int | None = None
    strict: bool = False
    yes: str = "Yes"
    term_places: int | None = None

    def sql(self, when: str | None = None) -> str:
        """The aggregate as SQL, restricted to rows where ``when`` holds."""
        if self.kind not in _KINDS:
            raise ValueError(f"measure {self.name}: unknown kind {self.kind}")
        cells = [quoted(c) for c in self.columns]
        if when is not None:
            cells = [f"IF({when}, {c}, NULL)" for c in cells]
        value = _KINDS[self.kind](self, cells, when)
        return value if self.digits is None else f"round({value}, {self.digits})"


def total(name: str, column: str, places: int | None = None) -> Measure:
    return Measure(name, "total", (column,), places)


def row_total(name: str, columns: Iterable[str], places: int | None = None) -> Measure:
    """Repeated columns count once."""
    return Measure(name, "row_total", tuple(as_names(columns)), places)


def mean(name: str, column: str, places: int | None = None, digits: int | None = None) -> Measure:
    return Measure(name, "mean", (column,), places, digits)


def reported(name: str, column: str) -> Measure:
    return Measure(name, "reported", (column,))


def suppressed(name: str, column: str) -> Measure:
    return Measure(name, "suppressed", (column,))


def rows(name: str) -> Measure:
    return Measure(name, "rows")


def yes_cells(name: str, columns: Iterable[str], yes: str = "Yes") -> Measure:
    return Measure(name, "yes_cells", tuple(as_names(columns)), yes=yes)


def yes_rows(name: str, columns: Iterable[str], yes: str = "Yes") -> Measure:
    return Measure(name, "yes_rows", tuple(as_names(columns)), yes=yes)


def weighted_ratio(
    name: str,
    part: str,
    base: str,
    weight: str,
    places: int | None = None,
    strict: bool = False,
    digits: int | None = None,
    term_places: int | None = None,
) -> Measure:
    columns = (part, base, weight)
    return Measure(name, "ratio", columns, places, digits, strict, term_places=term_places)


def gap(name: str, total_column: str, components: Iterable[str], places: int | None = None) -> Measure:
    return Measure(name, "gap", (total_column, *as_names(components)), places)


def _zero_if_none(total_: str) -> str:
    return f"coalesce({total_}, 0D)"


def _total(m: Measure, cells: list[str], when: str | None) -> str:
    return _zero_if_none(exact_sum(cells[0], m.places))


def _row_total(m: Measure, cells: list[str], when: str | None) -> str:
    return _zero_if_none(exact_sum(row_sum(cells), m.places))


def _mean(m: Measure, cells: list[str], when: str | None) -> str:
    return safe_div(exact_sum(cells[0], m.places), f"count({cells[0]})")


def _reported(m: Measure, cells: list[str], when: str | None) -> str:
    return f"count({cells[0]})"


def _suppressed(m: Measure, cells: list[str], when: str | None) -> str:
    missing = f"{quoted(m.columns[0])} IS NULL"
    return f"count_if({missing})" if when is None else f"count_if(({when}) AND {missing})"


def _rows(m: Measure, cells: list[str], when: str | None) -> str:
    return "count(1)" if when is None else f"count_if({when})"


def _yes_cells(m: Measure, cells: list[str], when: str | None) -> str:
    yes = [f"CAST({c} = {literal(m.yes)} AS INT)" for c in cells]
    return f"coalesce(sum(CAST({row_sum(yes)} AS BIGINT)), 0L)" if cells else "count_if(false)"


def _yes_rows(m: Measure, cells: list[str], when: str | None) -> str:
    return f"count_if({' OR '.join(f'{c} = {literal(m.yes)}' for c in cells) or 'false'})"


def _ratio(m: Measure, cells: list[str], when: str | None) -> str:
    part, base, weight = cells
    term = f"{safe_div(part, base)} * {weight}"
    if m.strict:
        weight = f"IF({term} IS NOT NULL, {weight}, NULL)"
    terms = steady_sum(term) if m.term_places is None else exact_sum(term, m.term_places)
    numerator = _zero_if_none(terms)
    return safe_div(numerator, exact_sum(weight, m.places))


def _gap(m: Measure, cells: list[str], when: str | None) -> str:
    whole, *parts = cells
    return _zero_if_none(exact_sum(f"{row_sum(parts)} - {or_zero(whole)}", m.places))


_KINDS = {
    "total": _total,
    "row_total": _row_total,
    "mean": _mean,
    "reported": _reported,
    "suppressed": _suppressed,
    "rows": _rows,
    "yes_cells": _yes_cells,
    "yes_rows": _yes_rows,
    "ratio": _ratio,
    "gap": _gap,
}


def summarise(
    df: DataFrame, by: str | Sequence[str], measures: Sequence[Measure]
) -> DataFrame:
    """Group by the given columns and compute every measure in one aggregation.

    An empty ``by`` gives one row for the whole table.
    """
    keys = as_names(by)
    names = [m.name for m in measures]
    repeated = sorted({n for n in names if names.count(n) > 1 or n in keys})
    if repeated:
        raise ValueError(f"result column(s) named twice: {', '.join(repeated)}")
    require_columns(df, keys, "grouping")
    for m in measures:
        require_columns(df, m.columns, f"measure {m.name}")
    return group_by(df, keys, [named(m.sql(), m.name) for m in measures])


def grouping_sets(df: DataFrame, tables: Mapping[str, tuple[str | Sequence[str], Sequence[Measure]]]) -> DataFrame:
    """One aggregation for tables of several grains: a row for each group of each different set of keys.

    ``tables`` maps a name to its keys and measures. Columns: every key, ``__grain`` (which set of keys a row belongs to), and
    ``__m<n>`` for each different aggregate. The table is read once; each row is counted in
    every grain, and partial sums of a task are merged before the shuffle.
    """
    grains = _grains(tables)
    keys = as_names([k for grain in grains for k in grain])
    for name, (by, measures) in tables.items():
        require_columns(df, [*as_names(by), *(c for m in measures for c in m.columns)], f"table {name}")
    aggregates = [F.expr(named(sql, name)) for sql, name in _aggregates(tables).items()]
    # bit k of the grouping id, from the left, says that key k is not grouped by
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in grain): n for n, grain in enumerate(grains)}
    numbered = "CASE __id " + " ".join(f"WHEN {i} THEN {n}" for i, n in ids.items()) + " END AS __grain"
    if not keys:
        return df.agg(*aggregates).selectExpr("0 AS __grain", "*")
    grouped = df.groupingSets([[col_q(k) for k in grain] for grain in grains], *map(col_q, keys))
    return grouped.agg(F.grouping_id().alias("__id"), *aggregates).selectExpr(numbered, "*").drop("__id")


def _grains(tables) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(as_names(by)) for by, _ in tables.values()))


def _aggregates(tables) -> dict[str, str]:
    """Each different aggregate and its column."""
    found = dict.fromkeys(m.sql() for _, measures in tables.values() for m in measures)
    return {sql: f"__m{i}" for i, sql in enumerate(found)}


def summarise_tables(
    df: DataFrame, tables: Mapping[str, tuple[str | Sequence[str], Sequence[Measure]]]
) -> dict[str, DataFrame]:
    """:func:`summarise` for many tables of different grains by one aggregation, which runs at once and is pinned.

    Tables are read off the pinned result, so ``df`` is read once for all of them.
    """
    for name, (by, measures) in tables.items():
        names = [*as_names(by), *(m.name for m in measures)]
        if len(set(names)) < len(names):
            raise ValueError(f"result column(s) named twice in table {name}")
    found, grains, columns = pinned(grouping_sets(df, tables)), _grains(tables), _aggregates(tables)
    return {
        name: found.where(f"__grain = {grains.index(tuple(as_names(by)))}").selectExpr(
            *map(quoted, as_names(by)), *[named(columns[m.sql()], m.name) for m in measures]
        )
        for name, (by, measures) in tables.items()
    }


def with_places(measures: Sequence[Measure], places: int | None) -> list[Measure]:
    """The same measures with exact sums of ``places`` digits."""
    return [replace(m, places=places) for m in measures]


def exact_totals(measures: Sequence[Measure], places: int) -> list[Measure]:
    """The same measures; sums of reported cells that state no places get ``places``, means and ratios stay."""
    sums = ("total", "row_total", "gap")
    return [replace(m, places=places) if m.kind in sums and m.places is None else m for m in measures]


def long_form(wide: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row per group and measure: ``measure``, ``value`` (double)."""
    ids = as_names(keys)
    values = [c for c in wide.columns if c not in ids]
    numbers = wide.selectExpr(
        *map(quoted, ids), *[named(f"CAST({quoted(c)} AS DOUBLE)", c) for c in values]
    )
    return numbers.unpivot(
        [col_q(k) for k in ids], [col_q(c) for c in values], "measure", "value"
    )


def suppression_check(df: DataFrame, by: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: reported, suppressed, and whether they add up to all rows."""
    keys = as_names(by)
    measures = [rows("members")]
    for c in columns:
        measures += [reported(f"{c}_reported", c), suppressed(f"{c}_suppressed", c)]
    counted = summarise(df, keys, measures)
    complete = [
        named(
            f"{quoted(c + '_reported')} + {quoted(c + '_suppressed')} = members", f"{c}_complete"
        )
        for c in columns
    ]
    return counted.selectExpr("*", *complete)


def reconcile_total(
    df: DataFrame, by: str | Sequence[str], total_column: str, components: Sequence[str],
    places: int | None = None,
) -> DataFrame:
    """Reported total, sum of its components, and components minus total."""
    return summarise(df, by, reconciliation(total_column, components, places))


def reconciliation(total_column: str, components: Sequence[str], places: int | None = None) -> list[Measure]:
    return [
        total("reported_total", total_column, places),
        row_total("component_total", components, places),
        gap("difference", total_column, components, places),
    ]
