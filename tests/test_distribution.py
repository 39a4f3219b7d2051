"""Quantiles, profiles, crosstabs, histograms."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rosterfold.operators import quantiles as q
from rosterfold.operators.crosstab import (
    column_values,
    count_percent_labels,
    crosstab,
    order_by_count,
    row_percentages,
    with_row_total,
)
from rosterfold.operators.distribution import histogram_bins, six_number_summary
from rosterfold.operators.profile import profile_numeric, profile_text

from .conftest import rows

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def expect_quantiles(df, data, by, **options):
    found = q.exact_quantiles(df, "x", PROBABILITIES, by, **options).collect()
    groups = {}
    for *key, x in data:
        groups.setdefault(tuple(key), []).append(x)
    assert len(found) == len(groups)
    for row in found:
        values = [x for x in groups[tuple(row[: len(by)])] if x is not None]
        got = list(row[len(by) :])
        if values:
            assert got == pytest.approx(list(np.quantile(values, PROBABILITIES)), rel=1e-12, abs=1e-12)
        else:
            assert got == [None] * len(PROBABILITIES)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
        ),
        min_size=1,
        max_size=60,
    ),
    st.sampled_from([2, 10, 10_000]),
)
def test_quantiles_match_numpy_at_any_sketch_accuracy(frame, data, accuracy):
    expect_quantiles(frame("g string, x double", data), data, ["g"], accuracy=accuracy)


@pytest.mark.parametrize("accuracy", [5, 10_000])
def test_quantiles_of_a_hot_group_with_frequent_values(spark, accuracy):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.lognormal(0, 3, 4000), np.zeros(3000), rng.normal(-9, 1, 2000)])
    data = [("hot", float(x)) for x in hot] + [(f"g{i % 50}", float(i)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    expect_quantiles(df, data, ["g"], accuracy=accuracy)


def test_quantiles_without_groups(spark):
    data = [(float(i * i % 997),) for i in range(3000)]
    df = spark.createDataFrame(data, "x double").repartition(5)
    expect_quantiles(df, data, [], accuracy=50)
    expect_quantiles(df.where("false"), [(None,)], [])


def test_numeric_profile(frame):
    df = frame(
        "yr string, `x.y` double",
        [("one", 5.0), ("none", None), ("none", None)]
        + [("four", v) for v in (1.0, 2.0, 4.0, 8.0)]
        + [("four", None)],
    )
    one, none, four = (
        {r["yr"]: r for r in profile_numeric(df, "x.y", "yr").collect()}[k]
        for k in ("one", "none", "four")
    )
    assert (one["n_missing"], one["mean"], one["sd"], one["p25"], one["hist"]) == (0, 5.0, None, 5.0, "▁▁▇▁▁")
    assert (none["n_missing"], none["complete_rate"]) == (2, 0.0)
    assert (none["mean"], none["p0"], none["p50"], none["hist"]) == (None, None, None, None)
    assert (four["n_missing"], four["complete_rate"], four["mean"]) == (1, 0.8, 3.75)
    assert four["sd"] == pytest.approx(3.0956959)
    assert [four[p] for p in ("p0", "p25", "p50", "p75", "p100")] == [1.0, 1.75, 3.0, 5.0, 8.0]
    # (1, 2.4] holds 1 and 2, (3.8, 5.2] holds 4, (6.6, 8] holds 8
    assert four["hist"] == "▇▁▃▁▃"


def test_text_profile(frame):
    long = "x" * 100
    df = frame(
        "k string, s string",
        [("a", None), ("a", ""), ("a", "  "), ("a", "é"), ("a", "é"), ("a", long), ("a", long), ("b", None)],
    )
    assert rows(profile_text(df, "s", "k")) == [
        ("a", 1, 6 / 7, 0, 100, 1, 4, 1), ("b", 1, 0.0, None, None, 0, 0, 0),
    ]


def states(frame):
    data = [("1", "CA")] * 3 + [("1", "HI"), ("1", None), ("1", "ZZ"), ("2", "CA")]
    return frame("yr string, state string", data)


def test_crosstab(frame):
    counts = crosstab(states(frame), "yr", "state", ["HI", "CA", None], total="Total")
    assert counts.columns == ["yr", "HI", "CA", "NA_", "Total"]
    assert rows(counts) == [("1", 1, 3, 1, 6), ("2", 0, 1, 0, 1)]
    assert rows(row_percentages(counts, "yr"))[1] == ("2", 0.0, 1.0, 0.0, 1.0)
    assert rows(count_percent_labels(counts, "yr"))[0] == (
        "1", "1 (16.7%)", "3 (50.0%)", "1 (16.7%)", "6 (100.0%)",
    )


def test_crosstab_keeps_missing_apart_from_text_and_names_unique(frame):
    df = frame("yr string, state string", [("1", "NA_"), ("1", None), ("1", "CA")])
    counts = crosstab(df, "yr", "state", ["NA_", None, "CA"], total="Total")
    assert counts.columns == ["yr", "NA_", "NA__", "CA", "Total"]
    assert rows(counts) == [("1", 1, 1, 1, 3)]
    with pytest.raises(ValueError, match="named twice"):
        crosstab(df, "yr", "state", ["CA", "Total"], total="Total")


def test_crosstab_finds_its_values(frame):
    df = states(frame)
    assert column_values(df, "state") == ["CA", "HI", "ZZ", None]
    assert rows(with_row_total(crosstab(df, "yr", "state"), "yr")) == [
        ("1", 3, 1, 1, 1, 6), ("2", 1, 0, 0, 0, 1),
    ]
    with pytest.raises(ValueError, match="too many"):
        column_values(df, "state", limit=2)
    assert [tuple(r) for r in order_by_count(df, "state").collect()] == [
        ("CA", 4), ("HI", 1), ("ZZ", 1), (None, 1),
    ]


def test_six_numbers(frame):
    df = frame("x double", [(v,) for v in (8.0, 1.0, None, 4.0, 2.0)])
    assert rows(six_number_summary(df, "x", 2)) == [(1.0, 1.75, 3.0, 3.75, 5.0, 8.0)]


def test_histogram(frame):
    df = frame("x double", [(float(v),) for v in (0, 1, 5, 10, 10)] + [(None,)])
    assert rows(histogram_bins(df, "x", 5)) == [
        (1, 0.0, 2.0, 2), (2, 2.0, 4.0, 0), (3, 4.0, 6.0, 1), (4, 6.0, 8.0, 0), (5, 8.0, 10.0, 2),
    ]
    flat = histogram_bins(frame("x double", [(3.0,), (3.0,)]), "x", 2)
    assert [r["n"] for r in flat.collect()] == [2, 0]
    assert histogram_bins(frame("x double", [(None,)]), "x").count() == 0


def test_quantiles_of_awkward_doubles(spark):
    """Neighbours in the last bit, all magnitudes, subnormals, both zeros, and what is no number."""
    near = [1.0]
    for _ in range(300):
        near.append(float(np.nextafter(near[-1], 2)))
    rng = np.random.default_rng(4)
    wide = [float(s * 10.0**e) for e in range(-320, 308, 7) for s in (1, -1)] + [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]
    data = [("near", x) for x in near for _ in range(2)] + [("wide", x) for x in wide] + [("one", 3.5)] * 50
    data += [("odd", x) for x in (float("nan"), float("inf"), float("-inf"), None, 2.0, 4.0)]
    order = rng.permutation(len(data))
    df = spark.createDataFrame([data[k] for k in order], "g string, x double").repartition(5)
    finite = [(g, x if x is not None and np.isfinite(x) else None) for g, x in data]
    found = {r[0]: list(r[1:]) for r in q.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], ["g"], accuracy=64).collect()}
    for g in ("near", "one", "odd"):
        values = [x for h, x in finite if h == g and x is not None]
        assert found[g] == list(np.quantile(values, [0.0, 0.25, 0.5, 1.0]))
    values = sorted(x for h, x in finite if h == "wide")
    assert found["wide"][0] == values[0] and found["wide"][-1] == values[-1] and found["wide"][2] == values[len(values) // 2]


def test_quantiles_run_no_job_before_they_are_read(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS x", "id % 3 AS g")
    spark.sparkContext.setJobGroup("planning", "quantiles")
    plans = [six_number_summary(df, "x"), profile_numeric(df, "x", "g")]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    assert [p.count() for p in plans] == [1, 3]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) > 0


def test_quantiles_without_groups_shuffle_counts_but_no_rows(spark):
    """All rows once met the one row of targets in a join by a constant, which one task then read."""
    df = spark.range(5000).selectExpr("CAST(id * 37 % 4999 AS DOUBLE) AS x").repartition(6)
    for found in (six_number_summary(df, "x", 2), q.exact_quantiles(df, "x", [0.5])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastNestedLoopJoin") == q.PASSES + 1
    numbers = sorted(float(k * 37 % 4999) for k in range(5000))
    want = (numbers[0], *np.quantile(numbers, [0.25, 0.5]), sum(numbers) / 5000, np.quantile(numbers, 0.75), numbers[-1])
    assert rows(six_number_summary(df, "x", 2)) == [want]
    for empty in ("false", "x IS NULL"):
        none = df.selectExpr("CAST(NULL AS DOUBLE) AS x").where(empty)
        assert rows(six_number_summary(none, "x", 2)) == [(None,) * 6]
