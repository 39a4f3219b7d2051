"""One-row-per-organisation fact sheet over two reporting years."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.functions.columns import group_by, named, quoted
from rosterfold.functions.labels import amount_text, money_label
from rosterfold.functions.numbers import pct, safe_div
from rosterfold.operators.change import (
    change_points,
    growth_label,
    growth_pct,
    pivot_years,
    points_label,
)
from rosterfold.operators.measures import (
    Measure,
    row_total,
    summarise,
    total,
    weighted_ratio,
)
from rosterfold.operators.merge import fact_join
from rosterfold.operators.projection import computed_columns
from rosterfold.operators.quantiles import attach
from rosterfold.operators.roster import in_years, period_filter


@dataclass(frozen=True)
class FactColumns:
    """Which columns of the stacked table feed the fact sheet.

    ``control`` and ``uncontrolled`` are (part, base, weight) of a weighted
    ratio; the quality score averages the first and one minus the second.
    """

    key: str
    year: str
    patients: tuple[str, ...]
    minority: tuple[str, ...]
    public_insurance: tuple[str, ...]
    uninsured: tuple[str, ...]
    over_poverty: tuple[str, ...]
    other_language: str
    control: tuple[str, str, str]
    uncontrolled: tuple[str, str, str]
    cost: str
    fte: str
    places: int | None = None

    def measures(self) -> list[Measure]:
        p = self.places
        return [
            row_total("patient_count", self.patients, p),
            row_total("minority_patient_count", self.minority, p),
            row_total("public_insurance_total", self.public_insurance, p),
            row_total("uninsured_total", self.uninsured, p),
            row_total("fpl_over_100_total", self.over_poverty, p),
            total("LOE_total", self.other_language, p),
            weighted_ratio("control_ratio", *self.control, places=p),
            weighted_ratio("uncontrolled_ratio", *self.uncontrolled, places=p),
            total("total_cost", self.cost, p),
            total("fte_total", self.fte, p),
        ]


def org_year_grain(df: DataFrame, facts: FactColumns) -> DataFrame:
    """All fact inputs per organisation and year, in one aggregation."""
    return summarise(df, [facts.key, facts.year], facts.measures())


def complement_ratio(ratio: str) -> str:
    return f"(1 - {ratio})"


def composite_score(control: str, uncontrolled: str) -> str:
    """Mean of a ratio and the complement of another; NULL if either is."""
    return f"({control} + {complement_ratio(uncontrolled)}) / 2"


def with_quality_score(grain: DataFrame) -> DataFrame:
    score = composite_score("control_ratio", "uncontrolled_ratio")
    return grain.withColumn("quality_score", F.expr(score))


def patient_trend(
    grain: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None
) -> DataFrame:
    """Patients of both years, growth in percent, and its label."""
    wide = pivot_years(grain, facts.key, facts.year, "patient_count", [old, new], "patients_")
    return computed_columns(
        wide,
        {
            "growth_pct": growth_pct(f"patients_{old}", f"patients_{new}"),
            "patient_growth_trend": growth_label("growth_pct", old, na_text),
        },
    )


def fact_patients(grain: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None) -> DataFrame:
    """Current patients and the growth label."""
    return patient_trend(grain, facts, old, new, na_text).selectExpr(
        quoted(facts.key), f"patients_{new} AS patient_count_display", "patient_growth_trend"
    )


def _of_year(grain: DataFrame, facts: FactColumns, year: str, **columns: str) -> DataFrame:
    chosen = period_filter(grain, facts.year, year)
    return chosen.selectExpr(quoted(facts.key), *[named(x, n) for n, x in columns.items()])


def fact_minority(grain: DataFrame, facts: FactColumns, year: str) -> DataFrame:
    return _of_year(grain, facts, year, minority_patient_count="minority_patient_count")


def _share(total_column: str) -> str:
    return pct(total_column, "patient_count")


def fact_insurance(grain: DataFrame, facts: FactColumns, year: str) -> DataFrame:
    return _of_year(
        grain,
        facts,
        year,
        pct_public_insurance=_share("public_insurance_total"),
        pct_uninsured=_share("uninsured_total"),
    )


def fact_over_poverty(grain: DataFrame, facts: FactColumns, year: str) -> DataFrame:
    return _of_year(grain, facts, year, pct_100_fpl=_share("fpl_over_100_total"))


def fact_language(grain: DataFrame, facts: FactColumns, year: str) -> DataFrame:
    return _of_year(grain, facts, year, pct_LOE=_share("LOE_total"))


def quality_trend(
    grain: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None
) -> DataFrame:
    """Quality score of both years, change in points, and its label."""
    scored = with_quality_score(grain)
    wide = pivot_years(scored, facts.key, facts.year, "quality_score", [old, new], "quality_")
    return computed_columns(
        wide,
        {
            "quality_change_pts": change_points(f"quality_{old}", f"quality_{new}"),
            "quality_measure_change": points_label("quality_change_pts", old, new, na_text),
        },
    )


def fact_quality_change(grain: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None) -> DataFrame:
    return quality_trend(grain, facts, old, new, na_text).selectExpr(
        quoted(facts.key), "quality_measure_change"
    )


COST_PER_HEAD = safe_div("total_cost", "patient_count")


def fact_cost(grain: DataFrame, facts: FactColumns, year: str, pad: bool = False) -> DataFrame:
    """Cost per patient as a label; ``pad`` right-aligns all amounts to the widest."""
    raw = _of_year(grain, facts, year, cost=COST_PER_HEAD)
    width = None
    if pad:
        widest = group_by(raw, [], [f"max(length({amount_text('cost')})) AS width"])
        raw, width = attach(raw, widest, []), "width"
    return raw.selectExpr(quoted(facts.key), named(money_label("cost", width), "cost_per_patient"))


def fact_fte(grain: DataFrame, facts: FactColumns, year: str) -> DataFrame:
    return _of_year(grain, facts, year, fte_total="fte_total")


def joined_fact_sheet(
    df: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None
) -> DataFrame:
    """The fact sheet as a chain of inner joins of single facts."""
    grain = org_year_grain(df, facts)
    sheet = fact_patients(grain, facts, old, new, na_text)
    for fact in (
        fact_minority(grain, facts, new),
        fact_insurance(grain, facts, new),
        fact_over_poverty(grain, facts, new),
        fact_language(grain, facts, new),
        fact_quality_change(grain, facts, old, new, na_text),
        fact_cost(grain, facts, new),
        fact_fte(grain, facts, new),
    ):
        sheet = fact_join(sheet, fact, facts.key)
    return sheet


def fact_sheet(
    df: DataFrame, facts: FactColumns, old: str, new: str, na_text: str | None = None
) -> DataFrame:
    """The same fact sheet from one aggregation per organisation.

    Every fact of the joined sheet needs a row of the new year and none needs
    one of the old year, so the joins reduce to that condition: one scan, one
    shuffle, no join.
    """
    by_name = {m.name: m for m in facts.measures()}

    def at(year: str, suffix: str, names: Iterable[str]) -> list[str]:
        when = in_years(facts.year, year)
        rows_ = named(f"count_if({when})", f"__rows{suffix}")
        return [rows_, *[named(by_name[n].sql(when), n + suffix) for n in names]]

    two_year = ("patient_count", "control_ratio", "uncontrolled_ratio")
    grain = group_by(
        period_filter(df, facts.year, old, new),
        [facts.key],
        [*at(old, "_old", two_year), *at(new, "", by_name)],
    ).where("__rows > 0")
    growth = growth_pct("IF(__rows_old > 0, patient_count_old, NULL)", "patient_count")
    change = change_points(
        composite_score("control_ratio_old", "uncontrolled_ratio_old"),
        composite_score("control_ratio", "uncontrolled_ratio"),
    )
    return grain.selectExpr(
        "*", named(growth, "__growth"), named(change, "__change")
    ).selectExpr(
        quoted(facts.key),
        "patient_count AS patient_count_display",
        named(growth_label("__growth", old, na_text), "patient_growth_trend"),
        "minority_patient_count",
        named(_share("public_insurance_total"), "pct_public_insurance"),
        named(_share("uninsured_total"), "pct_uninsured"),
        named(_share("fpl_over_100_total"), "pct_100_fpl"),
        named(_share("LOE_total"), "pct_LOE"),
        named(points_label("__change", old, new, na_text), "quality_measure_change"),
        named(money_label(COST_PER_HEAD), "cost_per_patient"),
        "fte_total",
    )
