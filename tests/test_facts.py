"""Two-year change and the fact sheet."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterfold.operators.change import growth_label, growth_pct, pivot_years
from rosterfold.plans import facts as f

from .conftest import rows

FACTS = f.FactColumns(
    key="org", year="yr", patients=("pa", "pb"), minority=("mi",), public_insurance=("pu",),
    uninsured=("un",), over_poverty=("ov",), other_language="la", control=("cc", "cb", "ca"),
    uncontrolled=("uc", "ub", "ua"), cost="co", fte="ft", places=2,
)
NUMBERS = ["pa", "pb", "mi", "pu", "un", "ov", "la", "cc", "cb", "ca", "uc", "ub", "ua", "co", "ft"]
SCHEMA = "org string, yr string, " + ", ".join(f"{n} double" for n in NUMBERS)


def row(org, yr, **cells):
    base = dict(pa=60.0, pb=40.0, mi=30.0, pu=50.0, un=12.5, ov=70.0, la=20.0, cc=5.0, cb=10.0,
                ca=100.0, uc=2.0, ub=10.0, ua=50.0, co=99950.0, ft=7.5)
    return (org, yr, *[{**base, **cells}[n] for n in NUMBERS])


def sheet(df, joined, **options):
    build = f.joined_fact_sheet if joined else f.fact_sheet
    return {r["org"]: r for r in build(df, FACTS, "2021", "2024", **options).collect()}


@pytest.mark.parametrize("joined", [False, True])
def test_fact_sheet(frame, joined):
    df = frame(
        SCHEMA,
        [
            row("a", "2021", pa=40.0, cc=4.0), row("a", "2024"),
            row("new", "2024"), row("old", "2021"), row("mid", "2022"),
            row("none", "2021", pa=None, pb=None), row("none", "2024", pa=None, pb=None, ca=None),
            row("shrunk", "2021", pb=140.0), row("shrunk", "2024"),
            row("same", "2021"), row("same", "2023"), row("same", "2024", co=1234567.0),
        ],
    )
    out = sheet(df, joined)
    assert sorted(out) == ["a", "new", "none", "same", "shrunk"]
    a = out["a"]
    assert (a["patient_count_display"], a["patient_growth_trend"]) == (100.0, "+25% since 2021")
    assert (a["minority_patient_count"], a["pct_public_insurance"], a["pct_uninsured"]) == (30.0, 50.0, 12.5)
    assert (a["pct_100_fpl"], a["pct_LOE"], a["fte_total"]) == (70.0, 20.0, 7.5)
    # control rises from 0.4 to 0.5, uncontrolled stays
    assert a["quality_measure_change"] == "+5 pts (2021-2024)"
    # 999.5 per head, ties to even
    assert a["cost_per_patient"] == "$1,000"
    assert out["new"]["patient_growth_trend"] is None
    assert out["new"]["quality_measure_change"] is None
    assert out["none"]["patient_count_display"] == 0.0
    assert (out["none"]["pct_LOE"], out["none"]["cost_per_patient"]) == (None, None)
    assert out["shrunk"]["patient_growth_trend"] == "-50% since 2021"
    assert out["same"]["patient_growth_trend"] == "+0% since 2021"
    assert out["same"]["cost_per_patient"] == "$12,346"
    assert sheet(df, joined, na_text="NA")["new"]["patient_growth_trend"] == "NA% since 2021"


cell = st.one_of(st.none(), st.integers(0, 3).map(float))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]), st.sampled_from(["2021", "2022", "2024"]),
            *[cell] * len(NUMBERS),
        ),
        max_size=8,
    )
)
def test_one_aggregation_equals_the_joins(frame, data):
    df = frame(SCHEMA, data)
    fused = f.fact_sheet(df, FACTS, "2021", "2024")
    joined = f.joined_fact_sheet(df, FACTS, "2021", "2024")
    assert fused.columns == joined.columns
    assert rows(fused) == rows(joined)


def test_padded_costs(frame):
    df = frame(SCHEMA, [row("a", "2024"), row("b", "2024", co=1234567890.0)])
    padded = f.fact_cost(f.org_year_grain(df, FACTS), FACTS, "2024", pad=True)
    assert rows(padded) == [("a", "$     1,000"), ("b", "$12,345,679")]


def test_pivot_and_back(frame):
    df = frame("o string, y string, v double", [("a", "2021", 1.0), ("a", "2024", 2.0), ("b", "2024", None), ("c", "2022", 9.0)])
    wide = pivot_years(df, "o", "y", "v", ["2021", "2024"], "p_")
    assert rows(wide) == [("a", 1.0, 2.0), ("b", None, None)]
    back = wide.unpivot(["o"], ["p_2021", "p_2024"], "y", "v").where("v IS NOT NULL")
    assert rows(back) == [("a", "p_2021", 1.0), ("a", "p_2024", 2.0)]


def test_pivot_refuses_a_second_row_of_a_key_and_year(frame):
    df = frame("o string, y string, v double", [("a", "2021", 1.0), ("a", "2021", 5.0)])
    with pytest.raises(Exception, match="more than one row of a key in 2021"):
        pivot_years(df, "o", "y", "v", ["2021"]).collect()



def test_growth_edges(frame):
    df = frame("a double, b double", [(0.0, 5.0), (None, 5.0), (5.0, None), (4.0, 4.0), (25.0, 28.0), (3.0, 2.0)])
    labels = df.select(F.expr(growth_label(growth_pct("a", "b"), "2021")).alias("x"))
    assert [r["x"] for r in labels.collect()] == [
        None, None, None, "+0% since 2021", "+12% since 2021", "-33.3% since 2021",
    ]
