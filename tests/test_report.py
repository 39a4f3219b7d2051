"""The whole report, from sheets on disk that carry the survey's own column names."""

import pytest

from rosterfold.plans import catalog as c
from rosterfold.operators.badges import merge_badges
from rosterfold.plans import report
from rosterfold.sources.sheets import scan_sheet
from rosterfold.sources.sinks import write_report, write_stacked

from .conftest import rows

ORGS = [*c.ROSTER[:3], "H80CS99999"]
STATE = dict(zip(ORGS, ("CA", "HI", "ZZ", "NY")))
SHEET_OF = {
    "T3a_": "Table3A", "T3b_": "Table3B", "T4_": "Table4", "T5_": "Table5", "T6a_": "Table6A",
    "%": "Table6BClinicalmeasures", "T7_": "Table7_1", "T8a_": "Table8A", "T9E_": "Table9E",
    "Twfc_": "Workforce",
}


def used_columns():
    specs = [*c.YEARLY, *c.DETAIL_BY_STATE, *c.DETAIL_PACIFIC, *c.PHYSICIAN_MEANS, *c.FACTS.measures()]
    return sorted({x for m in specs for x in m.columns if not x.startswith("T9D_")})


def write_workbook(spark, root, year, bump):
    """Every cell is the organisation's number plus ``bump``; one cell is suppressed."""
    path = f"{root}/H80{year}"
    info = [
        (o, year, f"Center {i}", "Town", STATE[o], f"0050{i}", "Urban", "1", "0", "-", "")
        for i, o in enumerate(ORGS)
    ]
    names = [*c.INFO_TEXT, *c.INFO_NUMBERS]
    ordered = ["GrantNumber", "ReportingYear", "HealthCenterName", "HealthCenterCity",
               "HealthCenterState", "HealthCenterZIPCode", "UrbanRuralFlag", *c.INFO_NUMBERS]
    info_df = spark.createDataFrame(info, ", ".join(f"{n} string" for n in ordered)).select(names)
    write_report(info_df.coalesce(1), f"{path}/{c.INFO_SHEET}.csv", "csv")
    by_sheet = {sheet: [] for sheet in c.TABLE_SHEETS}
    for column in used_columns():
        by_sheet[next(s for p, s in SHEET_OF.items() if column.startswith(p))].append(column)
    for sheet, columns in by_sheet.items():
        # table 4 is read by position up to its 30th column
        filler = 28 - len(columns) if sheet == "Table4" else int(not columns)
        columns = columns + [f"{sheet}_x{i}" for i in range(filler)]
        data = []
        for i, o in enumerate(ORGS):
            cells = [
                "-" if (i == 0 and x == "T3b_L1a_Cd") else str(i + 1 + bump) for x in columns
            ]
            data.append((f"id{i}", o, *cells))
        schema = ", ".join(f"`{n}` string" for n in [f"{sheet}_BHCMISID", "GrantNumber", *columns])
        write_report(spark.createDataFrame(data, schema).coalesce(1), f"{path}/{sheet}.csv", "csv")


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("survey"))
    for bump, year in enumerate(("2021", "2024")):
        write_workbook(spark, root, year, bump)
    loaded = report.load_survey(spark, root, ("2021", "2024"), fmt="csv")
    write_stacked(loaded, f"{root}/stacked")
    return spark.read.schema(loaded.schema).parquet(f"{root}/stacked")


def test_catalogue_matches_the_published_one():
    assert len(set(c.ROSTER)) == len(c.ROSTER) == 28
    assert len(c.WORKFORCE_COLUMNS) == len(set(c.WORKFORCE_COLUMNS)) == 57
    assert len(c.badge_columns()) == 12
    names = [m.name for m in c.YEARLY]
    assert len(names) == len(set(names))
    bands = [m for m in c.TABLE_3A if m.name.startswith("age_")]
    assert sorted(x for m in bands for x in m.columns) == sorted(
        f"T3a_L{n}_{x}" for n in range(1, 39) for x in ("Ca", "Cb")
    )
    private = next(m for m in c.TABLE_4 if m.name == "private_insurance")
    assert private.columns == ("T4_L11_Ca",)


def test_survey_keeps_the_roster_and_text(survey):
    assert survey.count() == 6
    zips = survey.where("ReportingYear = '2024'").select("HealthCenterZIPCode", "FundingHO")
    assert rows(zips) == [("00500", None), ("00501", None), ("00502", None)]


def test_report_tables(survey):
    tables = report.survey_report(survey)
    yearly = {r["ReportingYear"]: r for r in tables["yearly_measures"].collect()}
    # organisations count 1, 2, 3 in 2021 and one more each in 2024
    assert yearly["2021"]["patients"] == 12.0
    assert yearly["2024"]["age_5_12"] == 9.0 * 16
    assert yearly["2024"]["pre_post_grad"] == 9.0 * 57
    assert yearly["2024"]["pap_test"] == 3.0
    assert yearly["2024"]["private_insurance"] == 9.0
    # each term is its own weight, so the ratio is one
    assert yearly["2021"]["hypertension_control"] == 1.0
    assert "medicaid_collected" not in tables["yearly_measures"].columns
    assert rows(tables["asian_detail_suppressed"], "ReportingYear", "Asian_Indian", "Chinese") == [
        ("2021", 1, 0), ("2024", 1, 0),
    ]
    assert rows(tables["asian_detail_reported"], "ReportingYear", "Asian_Indian") == [("2021", 2), ("2024", 2)]
    assert rows(tables["state_labels"], "ReportingYear", "CA", "NY", "Total") == [
        ("2021", "1 (33.3%)", "0 (0.0%)", "3 (100.0%)"), ("2024", "1 (33.3%)", "0 (0.0%)", "3 (100.0%)"),
    ]
    assert tables["detail_by_state"].count() == 6
    assert rows(tables["physician_gap"], "ReportingYear", "difference") == [("2021", 30.0), ("2024", 45.0)]
    assert rows(tables["profile_T3b_L1_Cd"], "ReportingYear", "p0", "p50", "p100") == [
        ("2021", 1.0, 2.0, 3.0), ("2024", 2.0, 3.0, 4.0),
    ]
    facts = {r["GrantNumber"]: r for r in tables["fact_sheet"].collect()}
    assert sorted(facts) == sorted(c.ROSTER[:3])
    first = facts[c.ROSTER[0]]
    assert first["patient_growth_trend"] == "+100% since 2021"
    assert first["pct_100_fpl"] == 150.0
    assert first["quality_measure_change"] == "+0 pts (2021-2024)"
    assert first["cost_per_patient"] == "$0"
    for name, table in tables.items():
        assert table.collect(), name


def test_universe_report(frame):
    universe = frame(
        "GrantNumber string, ReportingYear string, T3a_L39_Ca double, T3a_L39_Cb double",
        [(c.ROSTER[0], "2021", 10.0, 15.0), ("other", "2021", 75.0, None), ("other", "2024", 5.0, 5.0)],
    )
    levels = [f"Health Center Quality Leader - {x}" for x in c.BADGE_LEVELS]
    names = [f"{x}_{y}" for y in c.BADGE_YEARS for x in levels]
    schema = ", ".join(f"`{n}` string" for n in [c.BADGE_KEY, *names])
    badges = frame(schema, [(c.ROSTER[0], *["Yes"] * len(names)), ("other", *["Yes"] * len(names))])
    tables = report.universe_report(universe, badges)
    shares = rows(tables["universe_shares"], "ReportingYear", "patients_pct", "members_pct")
    assert shares == [("2021", 25.0, 50.0), ("2024", 0.0, 0.0)]
    got = rows(tables["badge_rates"], "ReportingYear", "badge_year", "badges", "organisations", "badge_rate")
    assert got == [("2021", "2022", 3, 2, 150.0), ("2024", "2025", 3, 1, 300.0)]


def test_report_raises_on_a_missing_column(survey):
    with pytest.raises(ValueError, match="T3a_L39_Ca"):
        report.survey_report(survey.drop("T3a_L39_Ca"))
    with pytest.raises(ValueError, match="T9D_"):
        report.survey_report(survey, with_table_9d=True)


def test_badge_merge_with_repeated_and_missing_keys(frame):
    sheets = {
        "1": frame("k string, b string", [(None, "Yes"), (None, "No"), ("x", "Yes")]),
        "2": frame("k string, b string", [(None, "Yes"), ("y", None)]),
    }
    with pytest.raises(Exception, match="more than once"):
        merge_badges(sheets, "k").collect()
    merged = merge_badges(sheets, "k", unique_keys=False)
    assert rows(merged) == [(None, "No", "Yes"), (None, "Yes", "Yes"), ("x", "Yes", None), ("y", None, None)]


def test_csv_cells_with_line_breaks_and_surplus_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines, ""quoted"""\n2,x\n')
    assert rows(scan_sheet(spark, str(tmp_path), "a", "csv")) == [("1", 'two\nlines, "quoted"'), ("2", "x")]
    (tmp_path / "b.csv").write_text("k,v\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_sheet(spark, str(tmp_path), "b", "csv").collect()


def test_badge_report(spark, tmp_path):
    levels = [f"Health Center Quality Leader - {x}" for x in c.BADGE_LEVELS]
    schema = ", ".join(f"`{n}` string" for n in ["Grant Number", "HC Type", *levels])
    for year in c.BADGE_YEARS:
        data = [(c.ROSTER[0], "x", "Yes", None, None), ("other", "x", "Yes", "Yes", "No")]
        write_report(spark.createDataFrame(data, schema), f"{tmp_path}/{c.BADGE_SHEET.format(year=year)}.parquet")
    tables = report.badge_report(report.load_badges(spark, str(tmp_path)))
    assert rows(tables["badge_cells_members"]) == [(1, 1, 1, 1)]
    assert rows(tables["badge_cells_all"]) == [(3, 3, 3, 3)]
    assert rows(tables["badge_holders_members"]) == [(1, 1, 1, 1)]
    assert rows(tables["badge_count"])[0][:5] == (1, 1, 1, 1, 0)
    assert tables["badge_members"].count() == 1


def test_tables_of_several_grains_come_from_one_scan(spark, survey):
    from rosterfold.operators import measures as m

    found = m.grouping_sets(survey, {"a": (c.YEAR, c.YEARLY[:5]), "b": ([c.YEAR, c.STATE], c.DETAIL_BY_STATE), "c": ([], [m.rows("n")])})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Expand" in plan
    tables = m.summarise_tables(survey, {"years": (c.YEAR, [m.rows("n")]), "states": ([c.STATE, c.YEAR], [m.rows("n")]), "all": ([], [m.rows("n")])})
    assert rows(tables["all"]) == [(6,)] and rows(tables["years"]) == [("2021", 3), ("2024", 3)]
    assert rows(tables["states"]) == rows(m.summarise(survey, [c.STATE, c.YEAR], [m.rows("n")]))
    assert rows(m.summarise_tables(survey, {"all": ([], [m.rows("n")])})["all"]) == [(6,)]
    with pytest.raises(ValueError, match="twice"):
        m.summarise_tables(survey, {"x": (c.YEAR, [m.rows("n"), m.rows("n")])})


def test_groups_of_missing_keys_are_not_totals(frame):
    from rosterfold.operators import measures as m

    df = frame("a string, b string, x double", [("1", None, 1.0), (None, "p", 2.0), ("1", "p", None)])
    tables = m.summarise_tables(df, {"a": ("a", [m.total("t", "x", 2)]), "ab": (["a", "b"], [m.total("t", "x", 2)]), "all": ([], [m.total("t", "x", 2)])})
    assert rows(tables["a"]) == [(None, 2.0), ("1", 1.0)] and rows(tables["all"]) == [(3.0,)]
    assert rows(tables["ab"]) == [(None, "p", 2.0), ("1", None, 1.0), ("1", "p", 0.0)]


def test_rows_are_counted_by_the_job_that_writes_them(spark, survey, tmp_path):
    facts = report.survey_report(survey)["fact_sheet"]
    spark.sparkContext.setJobGroup("write", "counted")
    found = report.write_survey_report({"fact_sheet": facts}, str(tmp_path), expected={"fact_sheet": 3})
    counted = len(spark.sparkContext.statusTracker().getJobIdsForGroup("write"))
    spark.sparkContext.setJobGroup("plain", "not counted")
    facts.write.parquet(f"{tmp_path}/plain")
    assert counted == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain")) and found == {"fact_sheet": 3}
    assert spark.read.parquet(f"{tmp_path}/fact_sheet.parquet").count() == 3
    with pytest.raises(ValueError, match="3 rows, expected 28"):
        report.write_survey_report({"fact_sheet": facts}, f"{tmp_path}/again")


def test_badges_with_repeated_and_blank_keys_are_loaded(spark, tmp_path):
    levels = [f"Health Center Quality Leader - {x}" for x in c.BADGE_LEVELS]
    schema = ", ".join(f"`{n}` string" for n in ["Grant Number", "HC Type", *levels])
    for n, year in enumerate(c.BADGE_YEARS):
        data = [(c.ROSTER[0], "x", "Yes", None, None), (None, "x", "Yes", None, None), (None, "y", None, "Yes", None)]
        data += [("twice", "x", "Yes", None, None)] * (2 if n == 1 else 1)
        write_report(spark.createDataFrame(data, schema), f"{tmp_path}/{c.BADGE_SHEET.format(year=year)}.parquet")
    badges = report.load_badges(spark, str(tmp_path))
    got = rows(badges, "Grant Number")
    assert got == [(None,)] * 2 ** len(c.BADGE_YEARS) + [(c.ROSTER[0],)] + [("twice",)] * 2
    assert rows(report.badge_report(badges)["badge_members"], "Grant Number") == [(c.ROSTER[0],)]
