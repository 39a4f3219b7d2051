"""Roster, merges, stacking, yearly load and sheets on disk."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterfold.operators import merge
from rosterfold.operators.checks import assert_row_count, row_count_check
from rosterfold.operators.measures import summarise, total
from rosterfold.operators.merge import fact_join, outer_merge, stack_years
from rosterfold.operators.roster import key_cleanup, period_filter, roster_filter, roster_flag
from rosterfold.plans.load import load_all_years, load_year
from rosterfold.sources.pinning import pinned, shared_folder
from rosterfold.sources.sheets import roster_sheet, scan_sheet, scan_text_sheet, year_registry
from rosterfold.sources.sinks import write_report, write_stacked, write_year

from .conftest import rows


def test_roster_never_multiplies_and_drops_null_keys(frame):
    df = frame("org string, v int", [("a", 1), ("b", 2), (None, 3)])
    want = [("a", 1)]
    assert rows(roster_filter(df, "org", ["a", "a", "zz", None])) == want
    roster = frame("id string", [("a",), ("a",), ("zz",), (None,)])
    assert rows(roster_filter(df, "org", roster)) == want
    for r in (["a", "a"], roster):
        assert rows(roster_flag(df, "org", r)) == [(None, 3, False), ("a", 1, True), ("b", 2, False)]


def test_literal_roster_is_bounded(frame):
    with pytest.raises(ValueError, match="DataFrame"):
        roster_filter(frame("org int", [(1,)]), "org", range(20_000))


def test_key_cleanup(frame):
    df = frame("k string", [(None,), ("-,",), ("x-,",), ("h80",)])
    assert rows(key_cleanup(df, "k")) == [("h80",), ("x-,",)]


def test_period_filter_compares_text(frame):
    df = frame("yr string", [("2021",), ("bad",), (None,), ("2024",)])
    assert rows(period_filter(df, "yr", 2021, "2024")) == [("2021",), ("2024",)]


def test_outer_merge_keeps_every_key(frame):
    sheets = {
        "a": frame("k string, x double", [("1", 1.0), ("2", 2.0)]),
        "b": frame("k string, y string", [("2", "b"), ("3", "c"), (None, "n")]),
    }
    want = [("1", 1.0, None), ("2", 2.0, "b"), ("3", None, "c")]
    assert rows(outer_merge(sheets, "k")) == want
    assert rows(outer_merge(sheets, "k", unique_keys=False)) == want
    assert rows(outer_merge(sheets, "k", roster=["2", "3"])) == want[1:]
    assert len(rows(outer_merge(sheets, "k", keep_null_key=True))) == 4


def test_null_keys_can_match(frame):
    sheets = {
        "a": frame("k string, x int", [(None, 1), ("1", 2)]),
        "b": frame("k string, y int", [(None, 5), ("1", 6)]),
    }
    want = [(None, 1, 5), ("1", 2, 6)]
    assert rows(outer_merge(sheets, "k", keep_null_key=True)) == want
    assert rows(outer_merge(sheets, "k", keep_null_key=True, unique_keys=False)) == want
    assert rows(outer_merge(sheets, "k")) == [("1", 2, 6)]


def test_repeated_key_stops_the_fold_but_joins(frame):
    sheets = {
        "a": frame("k string, x int", [("1", 1), ("1", 2)]),
        "b": frame("k string, y int", [("1", 3)]),
    }
    with pytest.raises(Exception, match="more than once"):
        outer_merge(sheets, "k").collect()
    assert rows(outer_merge(sheets, "k", unique_keys=False)) == [("1", 1, 3), ("1", 2, 3)]
    # repeats outside the roster do no harm
    assert rows(outer_merge(sheets, "k", roster=["9"])) == []


def test_only_repeated_keys_are_joined(frame):
    sheets = {
        "a": frame("k string, x int", [("1", 1), ("1", 2), ("2", 3), (None, 4), (None, 5), ("5", 9)]),
        "b": frame("k string, y string", [("1", "p"), ("2", "q"), ("3", "r"), (None, "s")]),
        "c": frame("k string, z double", [("3", 0.5), ("4", 1.5), ("4", 2.5)]),
    }
    want = [
        (None, 4, "s", None), (None, 5, "s", None), ("1", 1, "p", None), ("1", 2, "p", None), ("2", 3, "q", None),
        ("3", None, "r", 0.5), ("4", None, None, 1.5), ("4", None, None, 2.5), ("5", 9, None, None),
    ]
    for unique in (None, False):
        assert rows(outer_merge(sheets, "k", keep_null_key=True, unique_keys=unique)) == want
        assert rows(outer_merge(sheets, "k", unique_keys=unique)) == want[2:]
    with pytest.raises(Exception, match="more than once"):
        outer_merge(sheets, "k").collect()


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_repeated_keys_are_multiplied_in_pieces(frame, monkeypatch, size):
    monkeypatch.setattr(merge, "PIECE_ROWS", size)
    sheets = {
        "a": frame("k string, x int", [(None, i % 3) for i in range(40)] + [("1", i) for i in range(20)] + [("2", 5), ("4", 1), ("4", 1)]),
        "b": frame("k string, y string", [(None, None), (None, "p"), (None, "p"), ("1", "q"), ("3", "r"), ("5", "s"), ("5", "t")]),
        "c": frame("k string, z array<int>", [("1", [i % 9]) for i in range(30)] + [("2", None), ("4", [1]), ("4", [2]), ("4", [2])]),
    }
    for null in (True, False):
        found, want = (outer_merge(sheets, "k", keep_null_key=null, unique_keys=unique) for unique in (None, False))
        assert found.columns == want.columns
        assert Counter(map(str, found.collect())) == Counter(map(str, want.collect()))


def test_a_frequent_key_is_not_multiplied_in_one_task(spark):
    """A sheet's 3,000 rows of the blank key against another's: the 9 million were shuffled to one task of the next join."""
    blank = spark.range(3000)
    sheets = {
        "a": blank.selectExpr("CAST(NULL AS BIGINT) AS k", "id % 5 AS x"),
        "b": blank.selectExpr("CAST(NULL AS BIGINT) AS k", "id AS y"),
        "c": spark.range(3).selectExpr("IF(id = 0, NULL, id) AS k", "id AS z"),
    }
    merged = outer_merge(sheets, "k", keep_null_key=True, unique_keys=None)
    by_task = merged.groupBy(F.spark_partition_id().alias("task"))
    found = [r["n"] for r in by_task.agg(F.count("*").alias("n")).collect()]
    assert sum(found) == 3000 * 3000 + 2 and max(found) < 0.6 * sum(found)
    assert merged.agg(F.sum("x"), F.sum("y"), F.sum("z")).first()[:] == (2 * 9_000_000, 3000 * 2999 // 2 * 3000, 3)


def test_keys_of_several_columns(frame):
    sheets = {
        "a": frame("y string, k string, x int, t string", [("1", "a", 1, "one"), ("2", "a", 2, None), (None, "a", 3, "no")]),
        "b": frame("k string, y string, z date", [("a", "2", None), ("b", "2", None)]),
    }
    want = [("1", "a", 1, "one", None), ("2", "a", 2, None, None), ("2", "b", None, None, None)]
    assert rows(outer_merge(sheets, ["y", "k"])) == want
    assert rows(outer_merge(sheets, ["y", "k"], unique_keys=None)) == want
    assert rows(outer_merge(sheets, ["y", "k"], roster=["b"], roster_key="k")) == want[2:]
    with pytest.raises(ValueError, match="roster"):
        outer_merge(sheets, ["y", "k"], roster=["b"])


def test_columns_that_move_between_sheets_and_types_between_years(frame):
    books = {
        "2021": {"a": frame("k string, m string", [("x", "1")]), "b": frame("k string, n double", [("x", 2.0)])},
        "2022": {"a": frame("k string, n string", [("x", "-")]), "b": frame("k string, m double, o string", [("x", 5.0, "7")])},
    }
    loaded = load_all_years(books, "k", ["o"])
    assert rows(loaded, "ReportingYear", "k", "m", "n", "o") == [("2021", "x", 1.0, 2.0, None), ("2022", "x", 5.0, None, "7")]
    assert rows(load_all_years(books, "k", ["o"], unique_keys=False), "ReportingYear", "m") == [("2021", 1.0), ("2022", 5.0)]
    with pytest.raises(ValueError, match="more than one sheet: m"):
        load_all_years({"2021": {"a": books["2021"]["a"], "b": books["2022"]["b"]}}, "k", ["o"])


def test_name_clash_is_an_error(frame):
    df = frame("k string, x int", [("1", 1)])
    with pytest.raises(ValueError, match="more than one sheet: x"):
        outer_merge({"a": df, "b": df}, "k")
    with pytest.raises(ValueError, match="both sides: x"):
        fact_join(df, df, "k")


def test_more_sheets_than_one_fold_holds(frame):
    sheets = {f"s{i}": frame(f"k int, c{i} int", [(i % 3, i)]) for i in range(65)}
    merged = outer_merge(sheets, "k")
    assert len(merged.columns) == 66
    assert merged.count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.dictionaries(st.integers(0, 6), st.one_of(st.none(), st.integers(-9, 9)), max_size=6),
        min_size=2,
        max_size=4,
    )
)
def test_fold_equals_chained_joins(frame, sheets):
    frames = {
        f"s{i}": frame(f"k int, c{i} int", list(cells.items())) for i, cells in enumerate(sheets)
    }
    assert rows(outer_merge(frames, "k")) == rows(outer_merge(frames, "k", unique_keys=False))


def test_stacking_is_by_name_and_keeps_duplicates(frame):
    a = frame("k string, x int", [("1", 1), ("1", 1)])
    b = frame("y int, k string", [(2, "1")])
    stacked = stack_years([a, b])
    assert stacked.columns == ["k", "x", "y"]
    assert rows(stacked) == [("1", None, 2), ("1", 1, None), ("1", 1, None)]


def test_row_count_check(frame):
    df = frame("k int", [(1,), (2,)])
    assert rows(row_count_check(df, 2)) == [(2, 2, True)]
    assert rows(row_count_check(df, frame("r int", [(1,)]))) == [(2, 1, False)]
    assert_row_count(df, df)
    with pytest.raises(ValueError, match="2 rows, expected 28"):
        assert_row_count(df, 28)


def year_sheets(frame, year="2021", info=None):
    return {
        "info": frame(
            "GrantNumber string, ReportingYear string, ZIP string",
            info or [("a", year, "00501"), ("-,", year, "1"), ("z", year, "9")],
        ),
        "t1": frame("GrantNumber string, `T_L2.1_Ca` string", [("a", "12"), ("b", "-")]),
        "t2": frame("GrantNumber string, m double", [("b", 5.0), (None, 1.0)]),
    }


def test_load_year(frame):
    loaded = load_year(year_sheets(frame), "2021", "GrantNumber", ["ZIP"], roster=["a", "b", "-,"])
    assert rows(loaded, "GrantNumber", "ReportingYear", "ZIP", "T_L2.1_Ca", "m") == [
        ("a", "2021", "00501", 12.0, None),
        ("b", "2021", None, None, 5.0),
    ]


def test_year_of_the_sheet_must_agree(frame):
    sheets = year_sheets(frame, info=[("a", "2020", "1")])
    with pytest.raises(Exception, match="workbook 2021 holds rows of year 2020"):
        load_year(sheets, "2021", "GrantNumber", ["ZIP"]).collect()


def test_totals_survive_merge_and_stack(frame):
    books = {y: year_sheets(frame, y) for y in ("2021", "2022")}
    stacked = load_all_years(books, "GrantNumber", ["ZIP"])
    sums = summarise(stacked, [], [total("m_total", "m"), total("t", "T_L2.1_Ca")])
    assert rows(sums) == [(10.0, 24.0)]


def test_sheets_on_disk(frame, spark, tmp_path):
    df = frame("id string, GrantNumber string, `x.1` string", [("0", "a", "-"), ("1", "b", "2")])
    write_report(df, f"{tmp_path}/H1/T.csv", "csv")
    write_report(df, f"{tmp_path}/H1/T.parquet")
    for fmt in ("csv", "parquet"):
        sheet = roster_sheet(spark, f"{tmp_path}/H1", "T", "GrantNumber", ["b"], fmt=fmt)
        assert sheet.columns == ["GrantNumber", "x.1"]
        assert rows(sheet) == [("b", "2")]
    text = scan_text_sheet(spark, f"{tmp_path}/H1/T.csv", ["id", "GrantNumber", "x.1"])
    assert rows(text) == rows(df)
    with pytest.raises(ValueError, match="missing"):
        scan_sheet(spark, f"{tmp_path}/H1", "T", columns=["nope"])
    with pytest.raises(ValueError, match="format"):
        scan_sheet(spark, f"{tmp_path}/H1", "T", fmt="xlsx")
    assert year_registry("r/", [2021, "2022"], "{root}/H{year}") == {"2021": "r/H2021", "2022": "r/H2022"}


def test_stacked_table_is_partitioned_and_replaced_by_year(frame, spark, tmp_path):
    path = f"{tmp_path}/stacked"
    write_stacked(frame("ReportingYear string, v int", [("2021", 1), ("2022", 2)]), path)
    write_year(frame("ReportingYear string, v int", [("2022", 9)]), path)
    back = spark.read.schema("v int, ReportingYear string").parquet(path)
    assert rows(back, "ReportingYear", "v") == [("2021", 1), ("2022", 9)]
    plan = back.where("ReportingYear = '2021'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ReportingYear" in plan


def test_pinning_uses_the_session_folder(frame, spark):
    folder = shared_folder(spark)
    assert rows(pinned(frame("k int", [(1,)]))) == [(1,)]
    assert shared_folder(spark) == folder or spark.sparkContext.getCheckpointDir()
