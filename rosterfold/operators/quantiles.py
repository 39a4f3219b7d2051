"""Exact grouped quantiles that never gather a whole group.

Wanted ranks are narrowed down by counting. A first pass counts values by sign and magnitude;
each further pass cuts the interval between the smallest and the largest value of the cell that holds a rank into
``cells`` of equal width and counts again; the last one counts single values. A cell is a
non-decreasing function of the value, so whatever rounding does, counts of lower cells are counts of lower values, and the result is exact.

A double has no more than 2^50 neighbours within a cell of the first pass, and every pass leaves about
``cells / 2`` times fewer, so after ``PASSES`` of them at most about 2^20 different values are left to be ordered. Every window
orders cells, or at most that many values: its size does not depend on the size of the group.
Nothing is sampled or sketched, so no intermediate result has to be fixed, and no job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import as_names, group_by, named, quoted
from rosterfold.functions.numbers import finite

#: Cells that an interval is cut into.
ACCURACY = 1 << 16

#: Passes that cut intervals.
PASSES = 2


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group columns to every row; every group of ``df`` is in ``per_group``.

    Without groups ``per_group`` is one row and arrives as a scalar subquery.
    Otherwise it is joined, without a hint: Spark broadcasts it when its size
    allows, and else splits a hot group's rows as it does in any join with skew.
    NULL groups match.
    """
    extra = [c for c in per_group.columns if c not in by]
    if not by:
        one = per_group.selectExpr(f"struct({', '.join(extra)}) AS one").scalar()
        return df.withColumn("__one", one).selectExpr(
            *df.columns, *[f"__one.{c} AS {c}" for c in extra]
        )
    keys = [f"__by{i}" for i in range(len(by))]
    right = per_group.selectExpr(*[f"{k} AS {r}" for k, r in zip(by, keys)], *extra)
    same = F.expr(" AND ".join(f"{k} <=> {r}" for k, r in zip(by, keys)))
    return df.join(right, same, "inner").drop(*keys)


def _keep(columns: Sequence[str]) -> list[str]:
    """Columns that are constant within the group."""
    return [f"any_value({c}) AS {c}" for c in columns]


#: Cell of a value by sign and magnitude: eight to each power of e, counted from below the smallest double.
_MAGNITUDE = "CASE WHEN __v = 0 THEN 0L WHEN __v > 0 THEN 1 + floor((ln(__v) + 750) * 8) ELSE -1 - floor((ln(-__v) + 750) * 8) END"


def _within(by: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(by)}" if by else ""


def _running(by: Sequence[str]) -> str:
    return f"sum(__c) OVER ({_within(by)} ORDER BY __cell ROWS UNBOUNDED PRECEDING)"


def _held(ranks: Sequence[int], here: str, before: str) -> list[str]:
    """For each rank, the ends of the cell that holds it and the number of values below that."""
    out = []
    for i in ranks:
        test = here.format(i=i)
        found = (("lo", "__low"), ("hi", "__high"), ("b", before.format(i=i)))
        out += [f"max(IF({test}, {value}, NULL)) AS __{name}{i}" for name, value in found]
    return out


def quantile_passes(
    rows: DataFrame,
    group: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str],
    accuracy: int = ACCURACY,
    others: Mapping[str, str] | None = None,
) -> DataFrame:
    """Quantiles, ``__min`` and ``__max``, plus any other statistics.

    ``rows`` and ``group`` come from :func:`cells`. ``others`` are named SQL aggregates over the rows, which
    may use ``__min`` and ``__max`` of their group as columns (if there are groups). Every group
    gets a row; without values its quantiles are NULL. ``accuracy`` is the number of cells of a pass; results do not depend on it.
    """
    others = dict(others or {})
    counts = ["count(__v) AS __c", "min(__v) AS __low", "max(__v) AS __high"]
    ranks = range(2 * len(probabilities))
    rank = []
    for p in probabilities:
        below = f"floor((__n - 1) * {float(p)!r}D)"
        rank += [f"({below} + 1)", f"least({below} + 2, __n)"]

    # by sign and magnitude
    whole = f"OVER ({_within(group)})"
    first = group_by(rows.withColumn("__cell", F.expr(_MAGNITUDE)), [*group, "__cell"], counts)
    placed = first.selectExpr("*", f"{_running(group)} AS __to", f"sum(__c) {whole} AS __n")
    placed = placed.selectExpr("*", *[f"{r} AS __r{i}" for i, r in zip(ranks, rank)])
    extent = ["any_value(__n) AS __n", "min(__low) AS __min", "max(__high) AS __max"]
    held = _held(ranks, "__to - __c < __r{i} AND __r{i} <= __to", "__to - __c")
    targets = group_by(placed, group, [*extent, *held])

    # by intervals of equal width, and last by value
    for last in [False] * PASSES + [True]:
        constant = [c for c in targets.columns if c not in group]
        inside = [f"__v >= __lo{i} AND __v <= __hi{i}" for i in ranks]
        ends = [
            f"coalesce({', '.join(f'IF({test}, __{end}{i}, NULL)' for i, test in zip(ranks, inside))}) AS __{name}"
            for end, name in (("lo", "from"), ("hi", "upto"))
        ]
        cut = f"IF(__upto > __from, floor((__v - __from) / (__upto - __from) * {int(accuracy)}), 0L)"
        # targets without groups are known to be one row, which goes to where the rows are
        beside = attach(rows, targets, group) if group else rows.crossJoin(targets)
        near = beside.selectExpr("*", *ends).where("__from IS NOT NULL OR __n = 0")
        counted = group_by(
            near.withColumn("__cell", F.expr("__v" if last else cut)), [*group, "__from", "__cell"], [*counts, *_keep(constant)]
        )
        # dealt by group once, for the counts within intervals and for the groups
        dealt = counted.repartition(*group) if group else counted
        placed = dealt.withColumn("__to", F.expr(_running([*group, "__from"])))
        placed = placed.selectExpr("*", *[f"{r} AS __r{i}" for i, r in zip(ranks, rank)])
        here = "__from = __lo{i} AND __b{i} + __to - __c < __r{i} AND __r{i} <= __b{i} + __to"
        kept = _keep(["__n", "__min", "__max"])
        targets = group_by(placed, group, [*kept, *_held(ranks, here, "__b{i} + __to - __c")])

    quantiles = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        low, high = f"__lo{2 * i}", f"__lo{2 * i + 1}"
        position = f"((__n - 1) * {float(p)!r}D)"
        share = f"({position} - floor({position}))"
        between = f"{low} * (1 - {share}) + {high} * {share}"
        quantiles.append(named(f"IF({low} = {high}, {low}, {between})", name))
    found = targets.selectExpr(*group, "__min", "__max", *quantiles)
    if not others:
        return found
    if any("__min" in x or "__max" in x for x in others.values()):
        rows = attach(rows, group_by(first, group, extent[1:]), group)
    more = group_by(rows, group, [named(x, n) for n, x in others.items()])
    return attach(found, more, group)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: str | Sequence[str] = (),
    names: Sequence[str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values of each group."""
    keys = as_names(by)
    group, rows = cells(df, value, keys)
    out = list(names or [f"q{p:g}" for p in probabilities])
    found = quantile_passes(rows, group, probabilities, out, accuracy).drop("__min", "__max")
    return named_groups(found, group, keys)


def cells(df: DataFrame, value: str, keys: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Only the group columns, under plain names, and the value as a finite double ``__v``."""
    group = [f"__g{i}" for i in range(len(keys))]
    return group, df.selectExpr(
        *[f"{quoted(k)} AS {g}" for k, g in zip(keys, group)],
        f"{finite(f'CAST({quoted(value)} AS DOUBLE)')} AS __v",
    )


def named_groups(result: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Group columns under their own names again."""
    rest = [quoted(c) for c in result.columns if c not in group]
    return result.selectExpr(*[named(g, k) for g, k in zip(group, keys)], *rest)
