"""Distribution of one value, and share of a larger population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rosterfold.functions.columns import as_names, group_by, named, quoted
from rosterfold.functions.numbers import exact_sum, pct, safe_div
from rosterfold.operators.measures import Measure
from rosterfold.operators.quantiles import ACCURACY, attach, cells, quantile_passes
from rosterfold.operators.roster import Roster, roster_flag


def six_number_summary(
    df: DataFrame, column: str, places: int | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """One row: min, q1, median, mean, q3, max."""
    ends = {
        "min": "min(__v)",
        "mean": safe_div(exact_sum("__v", places), "count(__v)"),
        "max": "max(__v)",
    }
    found = quantile_passes(
        cells(df, column, [])[1],
        [],
        [0.25, 0.5, 0.75],
        ["q1", "median", "q3"],
        accuracy,
        others=ends,
    )
    return found.select("min", "q1", "median", "mean", "q3", "max")


def histogram_bins(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Equal-width bins from minimum to maximum: bin, lower, upper, n; empty bins are kept.

    Bins are closed on the left, the last on both sides. If all values are
    equal there is no width, and everything is in the first bin.
    """
    rows = cells(df, column, [])[1].where("__v IS NOT NULL")
    extent = group_by(rows, [], ["min(__v) AS __min", "max(__v) AS __max"])
    bucket = f"IF(__min = __max, 1, least(width_bucket(__v, __min, __max, {bins}), {bins}))"
    counted = group_by(
        attach(rows, extent, []).selectExpr("__min", "__max", f"{bucket} AS __bin"),
        [],
        [
            "any_value(__min) AS __min",
            "any_value(__max) AS __max",
            *[f"count_if(__bin = {b}) AS __n{b}" for b in range(1, bins + 1)],
        ],
    ).where("__min IS NOT NULL")
    width = f"((__max - __min) / {bins})"
    entries = ", ".join(
        f"struct({b} AS bin, __min + {width} * {b - 1} AS lower,"
        f" {'__max' if b == bins else f'__min + {width} * {b}'} AS upper, __n{b} AS n)"
        for b in range(1, bins + 1)
    )
    return counted.selectExpr(f"inline(array({entries}))")


def share_of_universe(
    df: DataFrame,
    key: str,
    roster: Roster,
    by: str | Sequence[str],
    measures: Sequence[Measure],
    digits: int = 2,
) -> DataFrame:
    """Each measure for the roster and for everyone, and the roster's share in percent.

    One scan and one aggregation: roster rows are flagged, not read again.
    """
    flagged = roster_flag(df, key, roster, "__on")
    both, shares = [], []
    for m in measures:
        mine, all_ = f"{m.name}_roster", f"{m.name}_universe"
        both += [named(m.sql("__on"), mine), named(m.sql(), all_)]
        shares.append(named(pct(quoted(mine), quoted(all_), digits), f"{m.name}_pct"))
    return group_by(flagged, as_names(by), both).selectExpr("*", *shares)
