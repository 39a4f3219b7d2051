"""Change between years, labels, and the fact sheet."""

from __future__ import annotations

from rosterfold.functions.labels import money_label, number_text
from rosterfold.functions.numbers import pct
from rosterfold.operators.change import change_points, growth_pct, pivot_years
from rosterfold.operators.checks import ordered_report
from rosterfold.operators.crosstab import order_by_count
from rosterfold.operators.measures import long_form, row_total, summarise
from rosterfold.operators.merge import fact_join
from rosterfold.plans import facts as f
from rosterfold.verification import standin as s
from rosterfold.verification.registry import registered

OLD, NEW = s.OLD, s.NEW


def _grain(spark, sf):
    return f.org_year_grain(s.lines(spark, sf), s.FACTS)


_PATIENTS = f"p AS ({s.pivot_sql('patient_count', 'patients_')})"
_QUALITY = f"""scored AS (SELECT *, (control_ratio + (1 - uncontrolled_ratio)) / 2 AS quality_score
    FROM grain), q AS ({s.pivot_sql('quality_score', 'quality_', 'scored')})"""
_GROWTH = s.pct_sql(f"(patients_{NEW} - patients_{OLD})", f"patients_{OLD}")
_CHANGE = f"round((quality_{NEW} - quality_{OLD}) * 100, 1)"


@registered("pivot_years", f"WITH {s.GRAIN_SQL}, {_PATIENTS} SELECT * FROM p")
def pivoted(spark, sf):
    return pivot_years(_grain(spark, sf), "org", "yr", "patient_count", [OLD, NEW], "patients_")


@registered("growth_pct", f"WITH {s.GRAIN_SQL}, {_PATIENTS} SELECT *, {_GROWTH} AS growth FROM p")
def growth(spark, sf):
    wide = pivot_years(_grain(spark, sf), "org", "yr", "patient_count", [OLD, NEW], "patients_")
    change = growth_pct(f"patients_{OLD}", f"patients_{NEW}")
    return wide.selectExpr("*", f"{change} AS growth")


@registered(
    "change_points", f"WITH {s.GRAIN_SQL}, {_QUALITY} SELECT *, {_CHANGE} AS change FROM q"
)
def points(spark, sf):
    scored = f.with_quality_score(_grain(spark, sf))
    wide = pivot_years(scored, "org", "yr", "quality_score", [OLD, NEW], "quality_")
    change = change_points(f"quality_{OLD}", f"quality_{NEW}")
    return wide.selectExpr("*", f"{change} AS change")


@registered(
    "ordered_report",
    f"""WITH {s.LINES_SQL} SELECT yr, {s.row_sum_sql("qty_f", "qty_o")} AS total FROM lines
    GROUP BY yr ORDER BY yr""",
)
def ordered(spark, sf):
    yearly = summarise(
        s.lines(spark, sf), "yr", [row_total("total", ["qty_f", "qty_o"], s.PLACES)]
    )
    return ordered_report(yearly, "yr")


@registered(
    "order_by_count",
    f"WITH {s.STATE_SQL} SELECT state, count(*) AS n FROM stated GROUP BY state ORDER BY n DESC, state",
)
def states_by_count(spark, sf):
    return order_by_count(s.wide_with_state(spark, sf), "state")


@registered(
    "signed_label",
    f"""WITH {s.GRAIN_SQL}, {_PATIENTS}, {_QUALITY},
    g AS (SELECT org, {_GROWTH} AS growth_pct FROM p), c AS (SELECT org, {_CHANGE} AS change_pts FROM q)
    SELECT org, growth_pct, {s.signed_sql("growth_pct", f"% since {OLD}")} AS growth_label,
    change_pts, {s.signed_sql("change_pts", f" pts ({OLD}-{NEW})")} AS points_label
    FROM g JOIN c USING (org)""",
)
def signed_labels(spark, sf):
    grain = _grain(spark, sf)
    trend = f.patient_trend(grain, s.FACTS, OLD, NEW).selectExpr(
        "org", "growth_pct", "patient_growth_trend AS growth_label"
    )
    quality = f.quality_trend(grain, s.FACTS, OLD, NEW).selectExpr(
        "org", "quality_change_pts AS change_pts", "quality_measure_change AS points_label"
    )
    return fact_join(trend, quality, "org")


@registered(
    "money_label",
    f"""SELECT o_orderkey, {s.money_sql("o_totalprice")} AS money,
    regexp_replace(printf('%.1f', round(o_totalprice, 1)), '\\.0$', '') AS plain FROM orders""",
)
def money(spark, sf):
    return s.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"{money_label('o_totalprice')} AS money",
        f"{number_text('o_totalprice')} AS plain",
    )


@registered(
    "complement_ratio",
    f"WITH {s.GRAIN_SQL} SELECT org, yr, 1 - uncontrolled_ratio AS controlled_ratio FROM grain",
)
def complement(spark, sf):
    controlled = f.complement_ratio("uncontrolled_ratio")
    return _grain(spark, sf).selectExpr("org", "yr", f"{controlled} AS controlled_ratio")


@registered(
    "composite_score",
    f"WITH {s.GRAIN_SQL}, {_QUALITY} SELECT org, yr, quality_score FROM scored",
)
def composite(spark, sf):
    return f.with_quality_score(_grain(spark, sf)).select("org", "yr", "quality_score")


@registered(
    "pct_of_base",
    f"""WITH {s.GRAIN_SQL} SELECT org, yr,
    {s.pct_sql("uninsured_total", "patient_count")} AS pct_uninsured FROM grain""",
)
def percent_of_base(spark, sf):
    share = pct("uninsured_total", "patient_count")
    return _grain(spark, sf).selectExpr("org", "yr", f"{share} AS pct_uninsured")


@registered(
    "cost_per_head",
    f"WITH {s.GRAIN_SQL} SELECT org, yr, total_cost / nullif(patient_count, 0) AS cost FROM grain",
)
def cost_per_head(spark, sf):
    return _grain(spark, sf).selectExpr("org", "yr", f"{f.COST_PER_HEAD} AS cost")


@registered(
    "long_form",
    f"""WITH {s.GRAIN_SQL} SELECT org, yr, measure, value FROM (
    UNPIVOT (SELECT org, yr, patient_count, total_cost, fte_total FROM grain)
    ON patient_count, total_cost, fte_total INTO NAME measure VALUE value)""",
)
def long(spark, sf):
    chosen = _grain(spark, sf).select("org", "yr", "patient_count", "total_cost", "fte_total")
    return long_form(chosen, ["org", "yr"])


# The new year's part of each fact, as SQL over the grain.
_NEW_FACTS = {
    "fact_minority": {"minority_patient_count": "minority_patient_count"},
    "fact_insurance": {
        "pct_public_insurance": s.pct_sql("public_insurance_total", "patient_count"),
        "pct_uninsured": s.pct_sql("uninsured_total", "patient_count"),
    },
    "fact_fpl": {"pct_100_fpl": s.pct_sql("fpl_over_100_total", "patient_count")},
    "fact_language": {"pct_LOE": s.pct_sql('"LOE_total"', "patient_count")},
    "fact_cost": {
        "cost_per_patient": s.money_sql("(total_cost / nullif(patient_count, 0))"),
    },
    "fact_fte": {"fte_total": "fte_total"},
}
_BUILDERS = {
    "fact_minority": f.fact_minority,
    "fact_insurance": f.fact_insurance,
    "fact_fpl": f.fact_over_poverty,
    "fact_language": f.fact_language,
    "fact_cost": f.fact_cost,
    "fact_fte": f.fact_fte,
}


def _new_sql(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


def _register_new_fact(name: str) -> None:
    sql = f"WITH {s.GRAIN_SQL} SELECT org, {_new_sql(_NEW_FACTS[name])} FROM grain WHERE yr = '{NEW}'"

    @registered(name, sql)
    def fact(spark, sf):
        return _BUILDERS[name](_grain(spark, sf), s.FACTS, NEW)


for _name in _NEW_FACTS:
    _register_new_fact(_name)


_TREND_SQL = f"""g AS (SELECT org, patients_{NEW} AS patient_count_display, {_GROWTH} AS growth_pct
    FROM p), trend AS (SELECT org, patient_count_display,
    {s.signed_sql("growth_pct", f"% since {OLD}")} AS patient_growth_trend FROM g)"""
_QUALITY_SQL = f"""{_QUALITY}, c AS (SELECT org, {_CHANGE} AS change_pts FROM q),
    quality AS (SELECT org, {s.signed_sql("change_pts", f" pts ({OLD}-{NEW})")} AS quality_measure_change
    FROM c)"""


@registered(
    "fact_patients",
    f"WITH {s.GRAIN_SQL}, {_PATIENTS} SELECT org, patients_{NEW} AS patient_count_display FROM p",
)
def fact_patients(spark, sf):
    return f.fact_patients(_grain(spark, sf), s.FACTS, OLD, NEW).select(
        "org", "patient_count_display"
    )


@registered("fact_growth", f"WITH {s.GRAIN_SQL}, {_PATIENTS}, {_TREND_SQL} SELECT * FROM trend")
def fact_growth(spark, sf):
    return f.fact_patients(_grain(spark, sf), s.FACTS, OLD, NEW)


@registered("fact_quality_change", f"WITH {s.GRAIN_SQL}, {_QUALITY_SQL} SELECT * FROM quality")
def fact_quality_change(spark, sf):
    return f.fact_quality_change(_grain(spark, sf), s.FACTS, OLD, NEW)


_ALL_NEW = {name: sql for columns in _NEW_FACTS.values() for name, sql in columns.items()}
_SHEET_SQL = f"""WITH {s.GRAIN_SQL}, {_PATIENTS}, {_TREND_SQL}, {_QUALITY_SQL}
    SELECT * FROM trend JOIN (SELECT org, {_new_sql(_ALL_NEW)} FROM grain WHERE yr = '{NEW}') USING (org)
    JOIN quality USING (org)"""


@registered("fact_sheet", _SHEET_SQL)
def fact_sheet(spark, sf):
    return f.fact_sheet(s.lines(spark, sf), s.FACTS, OLD, NEW)


@registered("fact_sheet_joined", _SHEET_SQL)
def fact_sheet_joined(spark, sf):
    return f.joined_fact_sheet(s.lines(spark, sf), s.FACTS, OLD, NEW)
