"""Every registered query against DuckDB, and controls that a wrong one would fail."""

import pytest

import __spark_entry__ as entry
from rosterfold.verification.registry import ORACLE, QUERIES

from .conftest import rows
from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == []


def test_wrong_queries_are_caught(spark, con):
    right, sql = QUERIES["yearly_rowsum"], ORACLE["yearly_rowsum"]
    df = right(spark, SF)
    assert differences(df.selectExpr("yr", "total + 1 AS total"), con, sql)
    assert differences(df.where("yr > '1995'"), con, sql)
    assert differences(df.selectExpr("yr", "CAST(total AS BIGINT) AS total"), con, sql)
    assert differences(df.selectExpr("yr", "total AS sum"), con, sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["yr", "total"]
    years = [r["yr"] for r in df.collect()]
    assert years == sorted(years) and len(years) == 7
    assert rows(df)
