"""The whole yearly report: from workbooks to every published table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterfold.functions.columns import named, quoted
from rosterfold.functions.numbers import pct, row_sum
from rosterfold.operators import badges as b
from rosterfold.operators.checks import written_rows
from rosterfold.operators.crosstab import count_percent_labels, crosstab, row_percentages
from rosterfold.operators.distribution import histogram_bins, share_of_universe, six_number_summary
from rosterfold.operators.measures import exact_totals, long_form, reconciliation, rows, summarise, summarise_tables
from rosterfold.operators.profile import profile_numeric, profile_text
from rosterfold.operators.roster import Roster, roster_filter
from rosterfold.plans import catalog as c
from rosterfold.plans.facts import fact_sheet
from rosterfold.plans.load import load_stacked, scan_stacked
from rosterfold.sources.sheets import scan_sheet, year_registry
from rosterfold.sources.sinks import write_report


def load_survey(
    spark: SparkSession,
    root: str,
    years: tuple[str, ...] = c.YEARS,
    roster: Roster | None = c.ROSTER,
    fmt: str = "parquet",
    table_sheets: Mapping = c.TABLE_SHEETS,
) -> DataFrame:
    """One row per roster organisation and year, from workbooks under ``root``."""
    files = year_registry(root, years, c.WORKBOOK)
    info = [*c.INFO_TEXT, *c.INFO_NUMBERS]
    sheets = scan_stacked(spark, files, c.INFO_SHEET, info, table_sheets, c.KEY, fmt)
    return load_stacked(sheets, c.KEY, c.INFO_TEXT, roster=roster, year_column=c.YEAR)


def load_badges(
    spark: SparkSession, workbook: str, years: tuple[str, ...] = c.BADGE_YEARS, fmt: str = "parquet"
) -> DataFrame:
    """All organisations with their badges of every year side by side; repeated and blank keys are joined."""
    sheets = {y: scan_sheet(spark, workbook, c.BADGE_SHEET.format(year=y), fmt) for y in years}
    return b.merge_badges(sheets, c.BADGE_KEY, unique_keys=None)


def survey_report(
    survey: DataFrame,
    old: str = c.YEARS[0],
    new: str = c.YEARS[-1],
    with_table_9d: bool = False,
) -> dict[str, DataFrame]:
    """Published tables by name.

    All measures, by year and by year and state, come from one aggregation with grouping sets, which runs when the
    report is built; their tables are read off its result. Sums of cells are exact to ``c.PLACES`` decimals.
    A column that the survey lacks is an error. Table 9D is not among the loaded
    sheets, so its measures are only there if asked for.
    """
    states = crosstab(survey, c.YEAR, c.STATE, c.STATE_ORDER, total="Total")
    by_year = {
        "yearly_measures": [m for m in c.YEARLY if with_table_9d or m not in c.TABLE_9D],
        "asian_detail": c.DETAIL_ASIAN,
        "asian_detail_reported": c.DETAIL_ASIAN_REPORTED,
        "asian_detail_suppressed": c.DETAIL_ASIAN_SUPPRESSED,
        "pacific_detail": c.DETAIL_PACIFIC,
        "physician_means": c.PHYSICIAN_MEANS,
        "physician_gap": reconciliation(c.PHYSICIAN_TOTAL, c.PHYSICIAN_PARTS),
        "pharmacy_detail": c.PHARMACY_DETAIL,
        "members": [rows("members")],
    }
    grains = {name: (c.YEAR, measures) for name, measures in by_year.items()}
    grains["detail_by_state"] = ([c.YEAR, c.STATE], c.DETAIL_BY_STATE)
    measured = summarise_tables(survey, {name: (by, exact_totals(found, c.PLACES)) for name, (by, found) in grains.items()})
    row_total = named(row_sum([quoted(x) for x in c.ROW_TOTAL_COLUMNS]), "row_total")
    totals = survey.selectExpr(row_total)
    return {
        **measured,
        "yearly_measures_long": long_form(measured["yearly_measures"], c.YEAR),
        "state_counts": states,
        "state_shares": row_percentages(states, c.YEAR),
        "state_labels": count_percent_labels(states, c.YEAR),
        "key_profile": profile_text(survey, c.KEY, c.YEAR),
        "year_profile": profile_text(survey, c.YEAR, c.KEY),
        **{f"profile_{x}": profile_numeric(survey, x, c.YEAR) for x in c.PROFILED},
        "profile_by_organisation": profile_numeric(survey, c.PROFILED[0], [c.YEAR, c.KEY]),
        "row_total_summary": six_number_summary(totals, "row_total"),
        "row_total_histogram": histogram_bins(totals, "row_total"),
        "fact_sheet": fact_sheet(survey, c.FACTS, old, new),
    }


def write_survey_report(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", expected: Mapping[str, int] | None = None
) -> dict[str, int]:
    """Write every table under ``root`` and return their numbers of rows.

    Rows are counted by the jobs that write them; a table with another number than
    ``expected`` (by default one row of the fact sheet for each organisation on the roster) is an error.
    """
    expected = {"fact_sheet": len(c.ROSTER)} if expected is None else expected
    return {
        name: written_rows(table, lambda df, name=name: write_report(df, f"{root.rstrip('/')}/{name}.{fmt}", fmt), expected.get(name))
        for name, table in tables.items()
    }


def universe_report(
    universe: DataFrame, badges: DataFrame, roster: Roster = c.ROSTER, lag: int = 1
) -> dict[str, DataFrame]:
    """The roster's part of everyone, from a survey loaded with ``roster=None``.

    Badges of a year are earned with the survey of ``lag`` years before; the rate is
    the roster's badges in percent of all organisations of that survey.
    """
    patients = next(m for m in c.YEARLY if m.name == "patients")
    earned = b.badge_cells(roster_filter(badges, c.BADGE_KEY, roster), c.BADGE_YEARS, "").unpivot(
        [], list(c.BADGE_YEARS), "badge_year", "badges"
    )
    everyone = summarise(universe, c.YEAR, [rows("organisations")])
    same_year = F.expr(f"CAST(badge_year AS INT) - {lag} = CAST({quoted(c.YEAR)} AS INT)")
    return {
        "universe_shares": share_of_universe(universe, c.KEY, roster, c.YEAR, [patients, rows("members")]),
        "badge_rates": everyone.join(earned, same_year).selectExpr(
            quoted(c.YEAR), "badge_year", "badges", "organisations",
            named(pct("badges", "organisations", 6), "badge_rate"),
        ),
    }


def badge_report(badges: DataFrame, roster: Roster = c.ROSTER) -> dict[str, DataFrame]:
    """Badge tables for the roster and for everyone."""
    members = roster_filter(badges, c.BADGE_KEY, roster)
    return {
        "badge_members": members,
        "badge_count": b.badge_count(members, c.badge_columns()),
        "badge_cells_members": b.badge_cells(members, c.BADGE_YEARS, "total_member_badges_"),
        "badge_cells_all": b.badge_cells(badges, c.BADGE_YEARS, "total_badges_"),
        "badge_holders_members": b.badge_holders(members, c.BADGE_YEARS),
    }
