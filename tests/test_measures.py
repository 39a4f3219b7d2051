"""Declarative measures, suppression accounting, badges, shares."""

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rosterfold.operators import badges as b
from rosterfold.operators import measures as m
from rosterfold.operators.distribution import share_of_universe
from rosterfold.operators.roster import roster_filter

from .conftest import rows


def survey(frame):
    """All of m1 is suppressed in 2022."""
    return frame(
        "org string, yr string, m1 double, m2 double",
        [
            ("a", "2021", 1.0, None),
            ("b", "2021", None, 2.0),
            ("c", "2021", 4.0, 8.0),
            ("a", "2022", None, 3.0),
            ("b", "2022", None, None),
        ],
    )


def test_every_kind(frame):
    out = m.summarise(
        survey(frame),
        "yr",
        [
            m.total("total", "m1"),
            m.row_total("both", ["m1", "m2", "m1"]),
            m.mean("mean", "m1", digits=1),
            m.reported("reported", "m1"),
            m.suppressed("suppressed", "m1"),
            m.rows("members"),
            m.gap("gap", "m1", ["m2"]),
        ],
    )
    assert rows(out) == [
        ("2021", 5.0, 15.0, 2.5, 2, 1, 3, 5.0),
        ("2022", 0.0, 3.0, None, 0, 2, 2, 3.0),
    ]


def test_no_groups_give_one_row_even_for_no_rows(frame):
    empty = survey(frame).where("false")
    out = m.summarise(empty, [], [m.total("t", "m1"), m.mean("a", "m1"), m.yes_cells("y", ["org"])])
    assert rows(out) == [(0.0, None, 0)]


def test_restricted_measures(frame):
    df = survey(frame)
    kinds = [
        m.total("total", "m1"), m.row_total("both", ["m1", "m2"]), m.mean("mean", "m2"),
        m.reported("rep", "m2"), m.suppressed("sup", "m2"), m.rows("n"), m.gap("gap", "m1", ["m2"]),
    ]
    direct = m.summarise(df.where("yr = '2021'"), [], kinds)
    restricted = df.selectExpr(*[f"{x.sql(chr(96) + 'yr' + chr(96) + ' = ' + repr('2021'))} AS {x.name}" for x in kinds])
    assert rows(direct) == rows(restricted)


def test_weighted_ratio_drops_nulls_separately(frame):
    df = frame(
        "part double, base double, weight double",
        [(1.0, 2.0, 10.0), (None, 2.0, 30.0), (1.0, 0.0, 60.0), (0.0, 0.0, None)],
    )
    loose = m.weighted_ratio("r", "part", "base", "weight")
    strict = m.weighted_ratio("s", "part", "base", "weight", strict=True)
    exact = m.weighted_ratio("e", "part", "base", "weight", places=2)
    assert rows(m.summarise(df, [], [loose, strict, exact])) == [(0.05, 0.5, 0.05)]
    nothing = m.summarise(df.where("weight IS NULL"), [], [loose])
    assert rows(nothing) == [(None,)]


def test_weighted_ratio_keeps_small_terms(frame):
    df = frame("part double, base double, weight double", [(1e-8, 1.0, 1.0)] * 2)
    small = m.weighted_ratio("r", "part", "base", "weight", places=2)
    assert rows(m.summarise(df, [], [small])) == [(1e-8,)]


def test_missing_column_names_the_measure(frame):
    with pytest.raises(ValueError, match="measure cash: T9D_L3_Cb"):
        m.summarise(survey(frame), "yr", [m.total("cash", "T9D_L3_Cb")])


def test_bad_specs_are_errors(frame):
    with pytest.raises(ValueError, match="twice"):
        m.summarise(survey(frame), "yr", [m.rows("n"), m.total("n", "m1")])
    with pytest.raises(ValueError, match="twice"):
        m.summarise(survey(frame), "yr", [m.rows("yr")])
    with pytest.raises(ValueError, match="unknown kind"):
        m.Measure("x", "modus", ("m1",)).sql()
    assert m.with_places([m.rows("n")], 2)[0].places == 2


def test_reconcile(frame):
    df = frame("yr string, t double, a double, b double", [("2021", 10.0, 4.0, 2.0), ("2021", 5.0, None, 5.0)])
    assert rows(m.reconcile_total(df, "yr", "t", ["a", "b"])) == [("2021", 15.0, 11.0, -4.0)]


def test_long_form(frame):
    wide = m.summarise(survey(frame), "yr", [m.rows("members"), m.total("m.1", "m1")])
    assert rows(m.long_form(wide, "yr")) == [
        ("2021", "m.1", 5.0), ("2021", "members", 3.0), ("2022", "m.1", 0.0), ("2022", "members", 2.0),
    ]


cell = st.one_of(st.none(), st.integers(-1000, 1000).map(lambda n: n / 100))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["2021", "2022"]), cell, cell), max_size=12))
def test_reported_and_suppressed_make_all_rows(frame, data):
    df = frame("yr string, x double, y double", data)
    out = m.suppression_check(df, "yr", ["x", "y"]).collect()
    assert all(r["x_complete"] and r["y_complete"] for r in out)
    assert sum(r["members"] for r in out) == len(data)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["2021", "2022"]), cell, cell), max_size=12))
def test_fused_measures_equal_single_ones(frame, data):
    df = frame("yr string, x double, y double", data)
    specs = [
        m.total("total", "x", 2), m.row_total("both", ["x", "y"], 2), m.mean("mean", "y", 2),
        m.suppressed("sup", "x"), m.gap("gap", "x", ["y"], 2),
    ]
    fused = {r["yr"]: r.asDict() for r in m.summarise(df, "yr", specs).collect()}
    for spec in specs:
        for r in m.summarise(df, "yr", [spec]).collect():
            assert fused[r["yr"]][spec.name] == r[spec.name]


def badge_sheets(frame):
    gold, silver = "Quality - Gold", "Quality - Silver"
    columns = f"`Grant Number` string, `{gold}` string, `{silver}` string, `HC Type` string"
    return {
        "2022": frame(columns, [("a", "Yes", "Yes", "x"), ("b", "No", None, "x"), (None, "Yes", None, "x")]),
        "2023": frame(columns, [("a", None, "Yes", "y"), ("c", "Yes", "yes", "y")]),
    }


def test_badges(frame):
    merged = b.merge_badges(badge_sheets(frame), "Grant Number")
    assert merged.columns == [
        "Grant Number", "Quality - Gold_2022", "Quality - Silver_2022",
        "Quality - Gold_2023", "Quality - Silver_2023",
    ]
    assert merged.count() == 4
    # two cells, one organisation in 2022 besides the one without a number
    assert rows(b.badge_cells(merged, ["2022", "2023"])) == [(3, 2)]
    assert rows(b.badge_holders(merged, ["2022", "2023"])) == [(2, 2)]
    members = roster_filter(merged, "Grant Number", ["a", "b"])
    assert rows(b.badge_count(members, merged.columns[1:])) == [(1, 1, 0, 1)]
    assert rows(b.badge_cells(members, ["2024"])) == [(0,)]


def test_share_of_universe(frame):
    df = frame("org string, yr string, v double", [("a", "1", 1.0), ("b", "1", 3.0), (None, "1", 4.0), ("b", "2", 0.0)])
    for roster in (["a"], frame("id string", [("a",), ("a",)])):
        out = share_of_universe(df, "org", roster, "yr", [m.total("v", "v"), m.rows("n")])
        assert rows(out, "yr", "v_roster", "v_universe", "v_pct", "n_roster", "n_universe", "n_pct") == [
            ("1", 1.0, 8.0, 12.5, 1, 3, 33.33), ("2", 0.0, 0.0, None, 0, 1, 0.0),
        ]


@pytest.mark.parametrize("n, of, share", [(352285, 1422970, 24.757), (28, 1373, 2.039), (57, 1359, 4.194)])
def test_published_shares(frame, n, of, share):
    df = frame("org string, v double", [("m", float(n)), ("o", float(of - n))])
    out = share_of_universe(df, "org", ["m"], [], [m.total("v", "v")], digits=3)
    assert out.first()["v_pct"] == share


def test_steady_sum_does_not_depend_on_the_order(spark):
    import math
    import random

    from rosterfold.functions.numbers import steady_sum

    rnd = random.Random(3)
    groups = {
        "mixed": [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-12, 9) for _ in range(2000)],
        "tiny": [rnd.uniform(-1, 1) * 1e-25 for _ in range(500)],
        "large": [9e18, 1.0, -9e18],
        "none": [None, None],
        "zero": [0.1, -0.1],
    }
    seen = set()
    for seed in range(3):
        data = [(g, x) for g, values in groups.items() for x in [*values, None]]
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "g string, x double").repartition(1 + 2 * seed)
        got = {r.g: r.s for r in df.groupBy("g").agg(F.expr(f"{steady_sum('x')} AS s")).collect()}
        seen.add((got["mixed"], got["tiny"], got["zero"]))
        assert got["none"] is None and abs(got["large"]) < 2048
        for g in ("mixed", "tiny"):
            assert got[g] == pytest.approx(math.fsum(groups[g]), rel=1e-13)
        assert got["zero"] == 0
    assert len(seen) == 1


def test_sample_sd_of_units(spark):
    import statistics
    from fractions import Fraction

    from rosterfold.functions.numbers import sample_sd

    groups = {"a": [1e9 + k / 100 for k in range(500)], "b": [5.25] * 7, "c": [3.0], "d": [None], "e": [-2.5, 2.5, None, 0.01]}
    data = [(g, x) for g, values in groups.items() for x in values]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    got = {r.g: r.s for r in df.groupBy("g").agg(F.expr(f"{sample_sd('x', 2)} AS s")).collect()}
    for g, values in groups.items():
        exact = [Fraction(round(x * 100), 100) for x in values if x is not None]
        if len(exact) < 2:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(float(statistics.variance(exact)) ** 0.5, rel=1e-14, abs=0)
