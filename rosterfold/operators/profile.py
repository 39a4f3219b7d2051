"""Grouped column profiles: completeness, extent, moments, quartiles, shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rosterfold.functions.columns import as_names, group_by, quoted
from rosterfold.functions.numbers import exact_sum, safe_div, sample_sd
from rosterfold.operators.quantiles import ACCURACY, cells, named_groups, quantile_passes

# Bar characters of the inline histogram, lowest first.
BARS = "▁▂▃▅▆▇"
HISTOGRAM_BINS = 5


def _identity(text: str) -> str:
    """What texts are compared by: a digest, so that long cells are not shuffled."""
    return f"sha2({text}, 256)"


def profile_text(df: DataFrame, column: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Per group: missing, complete rate, shortest, longest, empty, distinct, blank.

    Distinct values are first reduced by (group, value), which spreads even a
    single hot group over all tasks.
    """
    x = f"CAST({quoted(column)} AS STRING)"
    return group_by(
        df,
        as_names(by),
        [
            f"count_if({x} IS NULL) AS n_missing",
            f"{safe_div(f'count({x})', 'count(1)')} AS complete_rate",
            f"min(length({x})) AS min_length",
            f"max(length({x})) AS max_length",
            f"count_if({x} = '') AS empty",
            f"count(DISTINCT {_identity(x)}) AS n_unique",
            f"count_if({x} RLIKE r'^\\s+$') AS whitespace",
        ],
    )


def _bars(counts: Sequence[str]) -> str:
    """One bar per count, its height in sixths of the largest; NULL without values."""
    top = f"greatest({', '.join(counts)})"
    bars = [
        f"substring('{BARS}', greatest(1, CAST(ceil(try_divide({c} * {len(BARS)}, {top})) AS INT)), 1)"
        for c in counts
    ]
    return f"IF({top} > 0, concat({', '.join(bars)}), NULL)"


def _bin_counts() -> dict[str, str]:
    """Counts in equal-width bins between ``__min`` and ``__max``, closed on the right."""
    width = f"((__max - __min) / {HISTOGRAM_BINS})"
    over = " + ".join(
        f"CAST(__v > __min + {width} * {k} AS INT)" for k in range(1, HISTOGRAM_BINS)
    )
    bin_ = f"IF(__min = __max, {HISTOGRAM_BINS // 2}, {over})"
    return {
        f"__b{k}": f"count_if(__v IS NOT NULL AND {bin_} = {k})" for k in range(HISTOGRAM_BINS)
    }


def profile_numeric(
    df: DataFrame,
    column: str,
    by: str | Sequence[str] = (),
    places: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group: missing, complete rate, mean, sd, five quantiles, bar sketch.

    A group without any value keeps its row, with NULL statistics.
    """
    keys = as_names(by)
    group, rows = cells(df, column, keys)
    moments = {
        "n_missing": "count_if(__v IS NULL)",
        "complete_rate": safe_div("count(__v)", "count(1)"),
        "mean": safe_div(exact_sum("__v", places), "count(__v)"),
        "sd": sample_sd("__v", places),
    }
    bins = _bin_counts()
    found = quantile_passes(
        rows,
        group,
        [0.25, 0.5, 0.75],
        ["p25", "p50", "p75"],
        accuracy,
        others={**moments, **bins},
    )
    shown = found.selectExpr(
        *group,
        *moments,
        "__min AS p0",
        "p25",
        "p50",
        "p75",
        "__max AS p100",
        f"{_bars(list(bins))} AS hist",
    )
    return named_groups(shown, group, keys)
