"""Properties of physical plans that keep queries cheap on large tables."""

import glob
import re

import pytest

import __spark_entry__ as entry
from rosterfold.operators.measures import row_total, summarise
from rosterfold.operators.merge import outer_merge
from rosterfold.operators.roster import roster_filter
from rosterfold.plans import facts as f
from rosterfold.verification import standin as s

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, table):
    return [l for l in plan.splitlines() if "FileScan" in l and f"{table}.parquet" in l]


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measures_need_one_scan_and_one_shuffle(spark):
    lines = s.lines(spark, SF)
    plan = physical(summarise(lines, "yr", [row_total("t", ["qty_f", "qty_o"], 2), *s.FACTS.measures()]))
    assert plan.count("Exchange") == 1
    assert "SortAggregate" not in plan
    (scan,) = scans(plan, "lineitem")
    assert "l_orderkey" not in scan and "l_partkey" not in scan


def test_fact_sheet_needs_one_shuffle_and_no_join(spark):
    plan = physical(f.fact_sheet(s.lines(spark, SF), s.FACTS, s.OLD, s.NEW))
    assert plan.count("Exchange") == 1
    assert "Join" not in plan


def test_merge_shuffles_once(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    sheets = {
        c: part.selectExpr("p_partkey AS k", f"CAST({c} AS DOUBLE) AS {c}") for c in ("p_size", "p_retailprice")
    }
    plan = physical(outer_merge(sheets, "k"))
    assert plan.count("Exchange") == 1
    assert "Sort" not in plan
    pruned = physical(outer_merge(sheets, "k").select("k", "p_size"))
    assert "p_retailprice" not in "".join(scans(pruned, "part"))


def test_merge_shuffles_rows_of_one_sheet_and_sorts_no_text(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    sheets = {
        "a": part.selectExpr("p_partkey AS k", "p_size", "p_retailprice", "p_name"),
        "b": part.selectExpr("p_partkey AS k", "p_retailprice * 2 AS price", "p_type"),
    }
    plan = physical(outer_merge(sheets, "k"))
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    # the union below the shuffle has the key, the sheet's number and a struct or two for each sheet
    (union,) = re.findall(r"Exchange hashpartitioning.*?\n.*?Union", plan, re.S)
    below = plan[plan.index(union) :]
    widths = [len(re.findall(r"#\d+", line)) for line in below.splitlines() if "Project" in line]
    assert widths and "named_struct(p_size" in below and "named_struct(price" in below
    fields = outer_merge(sheets, "k").select("k", "p_name", "p_type")
    assert "p_size" not in "".join(scans(physical(fields), "part"))


def test_scans_of_a_load_do_not_grow_with_the_years(spark, tmp_path):
    from rosterfold.plans.load import load_stacked, scan_stacked
    from rosterfold.sources.sheets import year_registry

    for n, year in enumerate(range(2001, 2008)):
        info = spark.createDataFrame([(f"h{i}", str(year), "CA") for i in range(3)], "k string, yr string, state string")
        cells = spark.createDataFrame([(f"id{i}", f"h{i}", str(i + n), "-") for i in range(4)], "id string, k string, a string, b string")
        info.coalesce(1).write.parquet(f"{tmp_path}/W+ {year}/Info.parquet")
        cells.coalesce(1).write.parquet(f"{tmp_path}/W+ {year}/Cells.parquet")

    def load(*years):
        files = year_registry(str(tmp_path), years, "{root}/W+ {year}")
        sheets = scan_stacked(spark, files, "Info", ["k", "yr", "state"], {"Cells": None}, "k")
        return load_stacked(sheets, "k", ["state"], roster=["h0", "h1", "h3"], year_column="yr")

    plans = [physical(load(*years)) for years in ((2001,), range(2001, 2008))]
    assert [p.count("FileScan") for p in plans] == [2, 2] and [p.count("Exchange") for p in plans] == [1, 1]
    got = sorted(tuple(r) for r in load(*range(2001, 2008)).select("yr", "k", "state", "a", "b").collect())
    assert got == sorted((str(y), f"h{i}", "CA" if i < 3 else None, float(i + y - 2001), None) for y in range(2001, 2008) for i in (0, 1, 3))


def test_years_from_a_table_prune_the_partitions_that_are_read(spark, tmp_path):
    from rosterfold.sources.sinks import write_stacked

    rows_ = spark.range(600).selectExpr("CAST(2001 + id % 6 AS STRING) AS ReportingYear", "id AS org", "CAST(id AS DOUBLE) AS v")
    write_stacked(rows_, f"{tmp_path}/stacked")
    spark.createDataFrame([("2001", 1), ("2004", 1), ("2005", 0)], "yr string, wanted int").write.parquet(f"{tmp_path}/years")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    stacked = spark.read.schema("org bigint, v double, ReportingYear string").parquet(f"{tmp_path}/stacked")
    wanted = spark.read.parquet(f"{tmp_path}/years").where("wanted = 1").select("yr")
    found = roster_filter(stacked, "ReportingYear", wanted)
    assert len(found.collect()) == 200
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", physical(found))


def test_literal_roster_reaches_the_scan(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = physical(roster_filter(items, "l_suppkey", [1, 2, 3]).select("l_quantity"))
    assert re.search(r"PushedFilters: \[In\(l_suppkey, \[1,2,3\]\)", plan)


def test_years_are_filtered_by_range_in_the_scan(spark):
    plan = physical(s.badge_sheet(spark, SF, "1998"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1998" in plan


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_crosses_rows_or_leaves_the_jvm(spark, name):
    plan = physical(entry.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "SinglePartition, REPARTITION"):
        assert operator not in plan


def test_sources_use_no_local_checkpoint_udf_or_broadcast_hint():
    for path in glob.glob("rosterfold/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        text = open(path).read()
        assert "localCheckpoint" not in text
        assert "udf" not in text.lower()
        assert "crossJoin" not in text
        assert "F.broadcast(" not in text
