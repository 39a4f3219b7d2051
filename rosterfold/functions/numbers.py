"""Null-safe arithmetic, as SQL text.

A missing, suppressed, NaN or infinite value is one thing here: SQL NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# A plain decimal number, optionally signed and with an exponent. Anything else
# (suppression marks, thousands separators, "1d", hexadecimal) is not a number.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(x: str) -> str:
    """NULL for NaN (which Spark orders above all numbers) and the infinities."""
    return f"IF(abs({x}) < double('Infinity'), {x}, NULL)"


def to_number(x: str, dtype: T.DataType) -> str:
    """Double from a column of type ``dtype``; text that is no number is NULL.

    Dates are days, points in time seconds since 1970-01-01; types without a
    number (binary, nested) are NULL.
    """
    if isinstance(dtype, T.StringType):
        return finite(f"IF({x} RLIKE r'{PLAIN_NUMBER}', try_cast(trim({x}) AS DOUBLE), NULL)")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(f"CAST({x} AS DOUBLE)")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return f"CAST({x} AS DOUBLE)"
    if isinstance(dtype, T.DateType):
        return f"CAST(unix_date({x}) AS DOUBLE)"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({x}) / 1e6D"
    if isinstance(dtype, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {x}) / 1e6D"
    return "CAST(NULL AS DOUBLE)"


def to_text(x: str, dtype: T.DataType) -> str:
    """Text from a column of type ``dtype``; whole floats under 1e15 lose their ``.0``.

    Larger ones are shown with an exponent, as a double shows them.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = f"{x} = floor({x}) AND abs({x}) < 1e15"
        return f"IF({whole}, CAST(try_cast({x} AS BIGINT) AS STRING), CAST({x} AS STRING))"
    return f"CAST({x} AS STRING)"


def or_zero(x: str) -> str:
    return f"coalesce({x}, 0)"


def safe_div(numerator: str, denominator: str) -> str:
    """Quotient, NULL when the denominator is zero or either side is NULL."""
    return f"try_divide({numerator}, {denominator})"


def row_sum(columns: Sequence[str]) -> str:
    """Sum across columns with NULL counting as zero."""
    if not columns:
        raise ValueError("row_sum needs at least one column")
    return "(" + " + ".join(map(or_zero, columns)) + ")"


# Whole units that surely fit a BIGINT, and the units that are summed apart from the rest.
MAX_UNITS = "9e18D"
LOW_UNITS = 1_000_000_000


def exact_sum(x: str, places: int | None = None) -> str:
    """Sum as a double, NULL for no values.

    Double sums depend on the order in which partitions are merged. With
    ``places`` each addend is rounded (half away from zero) to whole units of
    the last place, and whole billions of units and the rest are summed as two
    BIGINTs: that does not depend on the order, is several times faster than a
    decimal sum, and holds sums a billion times as large as a BIGINT. An addend of
    9e18 units or more, which no double states to the unit, is an error.
    """
    plain = f"sum(CAST({x} AS DOUBLE))"
    if places is None:
        return plain
    return f"CAST({_units_sum(_units(x, places))} AS DOUBLE) / 1e{places}D"


def _units(x: str, places: int) -> str:
    """Whole units of the last place, rounded half away from zero."""
    unit = f"1e{places}D"
    units = f"IF(({x}) < 0, ceil(({x}) * {unit} - 0.5D), floor(({x}) * {unit} + 0.5D))"
    too_large = f"raise_error(concat('too large for an exact sum: ', CAST({x} AS STRING)))"
    return f"IF(abs({x}) * {unit} >= {MAX_UNITS}, CAST({too_large} AS BIGINT), {units})"


def _units_sum(units: str) -> str:
    """Exact sum of BIGINTs as DECIMAL(38,0)."""
    return f"(CAST(sum(({units}) DIV {LOW_UNITS}L) AS DECIMAL(38,0)) * {LOW_UNITS} + sum(({units}) % {LOW_UNITS}L))"


#: Units of a fraction, and units of what is left of a fraction's unit.
FRACTIONS = 1 << 62


def steady_sum(x: str) -> str:
    """Sum of doubles with any number of decimals that does not depend on their order, NULL for no values.

    The whole part of an addend, its fraction in units of 2^-62 and what that leaves in units of 2^-124 are integers, and
    integers are summed: each in two parts as BIGINTs, which merge in any order. An addend loses
    less than 2^-124. From 9e18 on an addend has no fraction; sums with such addends are plain ones.
    """
    small = f"IF(abs({x}) < {MAX_UNITS}, CAST({x} AS DOUBLE), 0D)"
    whole = f"CAST({small} AS BIGINT)"
    scaled = f"(({small} - {whole}) * {FRACTIONS}D)"
    fraction = f"CAST({scaled} AS BIGINT)"
    rest = f"CAST(({scaled} - {fraction}) * {FRACTIONS}D AS BIGINT)"

    def halves(part: str) -> str:
        return f"(CAST(sum(shiftright({part}, 31)) AS DECIMAL(38,0)) * {1 << 31} + sum({part} & {(1 << 31) - 1}L))"

    def over(total: str) -> str:
        return f"CAST({total} DIV CAST({FRACTIONS} AS DECIMAL(38,0)) AS DECIMAL(38,0))"

    rests = halves(rest)
    fractions = f"({halves(fraction)} + {over(rests)})"
    left = [f"CAST({total} - {over(total)} * {FRACTIONS} AS DOUBLE)" for total in (fractions, rests)]
    steady = f"CAST({_units_sum(f'IF(({x}) IS NULL, NULL, {whole})')} + {over(fractions)} AS DOUBLE) + ({left[0]} + {left[1]} / {FRACTIONS}D) / {FRACTIONS}D"
    return f"IF(max(abs({x})) < {MAX_UNITS}, {steady}, sum(CAST({x} AS DOUBLE)))"


def sample_sd(x: str, places: int | None = None) -> str:
    """Sample standard deviation, NULL for fewer than two values.

    With ``places`` sums and sums of squares of whole units are exact integers, so that it does not depend on the
    order; squares that add up beyond 38 digits are an error.
    """
    if places is None:
        return f"IF(count({x}) > 1, stddev_samp({x}), NULL)"
    units = _units(x, places)
    total, n = _units_sum(units), f"count({x})"
    squares = f"sum(CAST({units} AS DECIMAL(19,0)) * CAST({units} AS DECIMAL(19,0)))"
    # sum and squares around the mean's whole part q: what is left of the sum, r, is less than n
    q = f"CAST({total} DIV {n} AS DECIMAL(38,0))"
    r = f"({total} - {q} * {n})"
    around = f"CAST({squares} - {q} * {q} * {n} - 2 * {q} * {r} AS DOUBLE) - CAST({r} AS DOUBLE) * CAST({r} AS DOUBLE) / {n}"
    return f"IF({n} > 1, sqrt(greatest(0D, {around}) / ({n} - 1)) / 1e{places}D, NULL)"


def pct(numerator: str, denominator: str, digits: int = 1) -> str:
    """Percentage rounded to ``digits``; multiplies first so ties are decimal ties."""
    return f"round(try_divide(100.0D * ({numerator}), {denominator}), {digits})"
