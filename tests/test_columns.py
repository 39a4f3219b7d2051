"""Quoting, selection, coercion, null-safe arithmetic and labels."""

import pytest
from pyspark.sql import functions as F

from rosterfold.functions.columns import as_names, at_positions, ending_with, starting_with
from rosterfold.functions.labels import count_pct_label, money_label, number_text, signed_label
from rosterfold.functions.numbers import exact_sum, pct, row_sum, safe_div
from rosterfold.operators.projection import (
    coerce_types,
    computed_columns,
    drop_by_prefix,
    named_projection,
    positional_projection,
    round_numeric,
    select_by_suffix,
    select_rename,
    suffix_columns,
)

from .conftest import rows

HOSTILE = ["Grant Number", "Twfc_L2.1_Ca", "%ofX-up", "HC Type_2022", "hc type b_2022", "tick`s"]


def values(df, expression):
    return [r[0] for r in df.select(F.expr(expression)).collect()]


def hostile(frame):
    schema = ", ".join("`" + c.replace("`", "``") + "` double" for c in HOSTILE)
    return frame(schema, [(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)])


def test_names_keep_first_occurrence():
    assert as_names(["a", "b", "a"]) == ["a", "b"]
    assert as_names("a") == ["a"]


def test_selectors_ignore_case(frame):
    df = hostile(frame)
    assert starting_with(df, "hc type") == ["HC Type_2022", "hc type b_2022"]
    assert ending_with(df, "_ca") == ["Twfc_L2.1_Ca"]


def test_hostile_names_survive_every_projection(frame):
    df = hostile(frame)
    assert named_projection(df, HOSTILE).columns == HOSTILE
    assert drop_by_prefix(df, "HC Type").columns == ["Grant Number", "Twfc_L2.1_Ca", "%ofX-up", "tick`s"]
    suffixed = suffix_columns(df, "_2023", "Grant Number")
    assert suffixed.columns == ["Grant Number"] + [c + "_2023" for c in HOSTILE[1:]]
    assert select_by_suffix(df, "2022", keep=["Grant Number"]).columns == [
        "Grant Number", "HC Type_2022", "hc type b_2022",
    ]
    assert select_rename(df, {"x.y": "tick`s"}).first()[0] == 6.0
    assert coerce_types(df, ["Grant Number"]).first()["Grant Number"] == "1"


def test_positions_put_the_key_first_and_drop_the_first_column(frame):
    df = frame("id int, a int, k int, b int", [(0, 1, 2, 3)])
    assert positional_projection(df, "k").columns == ["k", "a", "b"]
    assert positional_projection(df, "k", [2, 4]).columns == ["k", "a", "b"]
    assert positional_projection(df, "k", [1, 3]).columns == ["k", "id"]
    with pytest.raises(ValueError, match="position 9"):
        at_positions(df, [9])


def test_missing_column_is_named(frame):
    with pytest.raises(ValueError, match="nope"):
        named_projection(frame("a int", [(1,)]), ["a", "nope"])


@pytest.mark.parametrize(
    "text, number",
    [
        ("12", 12.0), (" 12 ", 12.0), ("-", None), ("", None), (None, None), ("1e3", 1000.0),
        ("1,234", None), ("1d", None), ("1f", None), ("0x1A", None), ("NaN", None), ("Inf", None),
        ("-.5", -0.5), ("5.", 5.0), ("1e999", None), ("--1", None),
    ],
)
def test_text_to_number(frame, text, number):
    df = coerce_types(frame("org string, m string", [("o", text)]), ["org"])
    assert df.first()["m"] == number


def test_not_a_number_and_infinity_become_null(frame):
    df = frame("m double", [(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)])
    assert [r[0] for r in coerce_types(df, []).collect()] == [None, None, None, 1.5]


def test_whole_floats_become_plain_text(frame):
    df = coerce_types(frame("zip double", [(96813.0,), (1.5,), (None,)]), ["zip"])
    assert [r[0] for r in df.collect()] == ["96813", "1.5", None]


def test_row_sum_counts_null_as_zero(frame):
    df = frame("a double, b double", [(None, None), (1.0, None), (1.0, 2.0)])
    assert values(df, row_sum(["a", "b"])) == [0.0, 1.0, 3.0]


def test_division_by_zero_is_null(frame):
    df = frame("n double, d double", [(1.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, 2.0)])
    assert values(df, safe_div("n", "d")) == [None, None, None, 1.5]
    assert values(df, pct("n", "d")) == [None, None, None, 150.0]


def test_exact_sum_does_not_depend_on_order(frame):
    numbers = [(0.1,), (0.2,), (1e10 + 0.01,), (-1e10,), (0.3,)] * 7
    forward = frame("x double", numbers).coalesce(1)
    backward = frame("x double", numbers[::-1]).repartition(4)
    assert values(forward, exact_sum("x", 2)) == values(backward, exact_sum("x", 2)) == [4.27]


def test_exact_sum_rounds_half_away_from_zero(frame):
    assert values(frame("x double", [(0.125,), (-0.125,), (0.125,)]), exact_sum("x", 2)) == [0.13]
    assert values(frame("x double", [(None,)]), exact_sum("x", 2)) == [None]


def test_exact_sum_beyond_a_bigint(frame):
    # 5 * 8e18 units do not fit a BIGINT, 0.25 is still counted
    huge = [(8e16,)] * 5 + [(-8e16,)] * 5 + [(0.25,)]
    assert values(frame("x double", [(8e16,)] * 5), exact_sum("x", 2)) == [4e17]
    assert values(frame("x double", huge), exact_sum("x", 2)) == [0.25]
    with pytest.raises(Exception, match="too large for an exact sum"):
        values(frame("x double", [(1e30,), (1.0,)]), exact_sum("x", 2))


def test_number_text(frame):
    df = frame("x double", [(12.0,), (12.34,), (-0.04,), (0.25,), (None,), (1234567.5,)])
    assert values(df, number_text("x")) == ["12", "12.3", "0", "0.3", None, "1234567.5"]


def test_signed_label(frame):
    df = frame("x double", [(12.3,), (-4.0,), (0.0,), (-0.04,), (None,)])
    assert values(df, signed_label("x", "% since 2021")) == [
        "+12.3% since 2021", "-4% since 2021", "+0% since 2021", "+0% since 2021", None,
    ]
    assert values(df, signed_label("x", " it's", na_text="NA"))[-1] == "NA it's"


def test_money_label(frame):
    df = frame("x double", [(999.5,), (1000.0,), (1234567.0,), (None,), (-0.4,), (2.5,)])
    assert values(df, money_label("x")) == ["$1,000", "$1,000", "$1,234,567", None, "$0", "$2"]
    assert values(df, money_label("x", "9"))[1] == "$    1,000"


def test_count_label(frame):
    df = frame("n bigint, t bigint", [(7, 28), (1, 16), (0, 0)])
    assert values(df, count_pct_label("n", "t")) == ["7 (25.0%)", "1 (6.2%)", "0 (-%)"]


def test_round_numeric_skips_text_and_listed(frame):
    df = frame("k string, id double, x double", [("a", 1.234, 2.675)])
    assert rows(round_numeric(df, 2, skip=["id"])) == [("a", 1.234, 2.68)]


def test_computed_columns_see_earlier_ones(frame):
    df = computed_columns(frame("a int", [(2,)]), {"b": "a * 2", "c": "b + 1"})
    assert rows(df) == [(2, 4, 5)]
