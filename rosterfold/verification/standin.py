"""The driver's tables read as a survey, in Spark and in SQL.

=====================  ====================================================
survey                 tables
=====================  ====================================================
organisation           supplier (``org``)
reporting year         year of ``l_shipdate`` as text (``yr``)
state                  nation of the supplier
survey rows            line items: quantities by line status and return flag
wide table             one row per organisation and year, a cell per return
                       flag and line status; cells of fewer than 16 line
                       items are suppressed
roster                 suppliers without debt
badges                 order priorities a customer used in a year
=====================  ====================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterfold.functions.columns import group_by, named, quoted
from rosterfold.functions.numbers import exact_sum
from rosterfold.operators.merge import fact_join
from rosterfold.plans.facts import FactColumns
from rosterfold.sources.sheets import WORKBOOK, scan_sheet

OLD, NEW = "1997", "2000"
YEARS = tuple(str(y) for y in range(1995, 2002))
PLACES = 2
MIN_ROWS = 16

FLAGS = ("A", "N", "R")
STATUSES = ("F", "O")
CELLS = tuple(f"{f}{s}" for f in FLAGS for s in STATUSES)
STATES = tuple(f"NATION_{i}" for i in range(25))
LEVELS = {"Gold": "1-URGENT", "Silver": "2-HIGH", "Bronze": "3-MEDIUM"}
BADGE_KEY = "Grant Number"
BADGE = "Health Center Quality Leader - {}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_sheet(spark, sf_dir, name)


YEAR_TEXT = "CAST(year(l_shipdate) AS STRING)"


def lines(spark: SparkSession, sf_dir: str, years: tuple[str, ...] = ()) -> DataFrame:
    """Every line item as a survey row; absent categories are NULL.

    ``years`` are tested on the stored date too, where the scan can use the test.
    """

    def only(column: str, value: str) -> str:
        return f"IF({column} = '{value}', l_quantity, NULL)"

    items = table(spark, sf_dir, "lineitem")
    if years:
        spans = [f"(l_shipdate >= '{y}-01-01' AND l_shipdate < '{int(y) + 1}-01-01')" for y in years]
        items = items.where(" OR ".join(spans))
    return items.selectExpr(
        "l_suppkey AS org",
        f"{YEAR_TEXT} AS yr",
        "l_quantity AS qty",
        "l_extendedprice AS price",
        f"{only('l_linestatus', 'F')} AS qty_f",
        f"{only('l_linestatus', 'O')} AS qty_o",
        f"{only('l_returnflag', 'A')} AS qty_a",
        f"{only('l_returnflag', 'N')} AS qty_n",
        f"{only('l_returnflag', 'R')} AS qty_r",
        "l_discount AS disc",
        "l_extendedprice * l_discount AS disc_part",
        "l_extendedprice * l_tax AS tax_part",
    )


LINES_SQL = """lines AS (
    SELECT l_suppkey AS org, CAST(year(l_shipdate) AS VARCHAR) AS yr,
        l_quantity AS qty, l_extendedprice AS price,
        CASE WHEN l_linestatus = 'F' THEN l_quantity END AS qty_f,
        CASE WHEN l_linestatus = 'O' THEN l_quantity END AS qty_o,
        CASE WHEN l_returnflag = 'A' THEN l_quantity END AS qty_a,
        CASE WHEN l_returnflag = 'N' THEN l_quantity END AS qty_n,
        CASE WHEN l_returnflag = 'R' THEN l_quantity END AS qty_r,
        l_discount AS disc, l_extendedprice * l_discount AS disc_part,
        l_extendedprice * l_tax AS tax_part
    FROM lineitem)"""


def _cells(column: str) -> list[str]:
    out = []
    for f in FLAGS:
        for s in STATUSES:
            inside = f"l_returnflag = '{f}' AND l_linestatus = '{s}'"
            value = exact_sum(f"IF({inside}, {column}, NULL)", PLACES)
            shown = f"IF(count_if({inside}) >= {MIN_ROWS}, {value}, NULL)"
            out.append(f"{shown} AS {column[2:5]}_{f}{s}")
    return out


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per organisation and year: ``n`` and suppressed quantity cells."""
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS org",
        f"{YEAR_TEXT} AS yr",
        "l_quantity",
        "l_returnflag",
        "l_linestatus",
    )
    all_quantity = f"{exact_sum('l_quantity', PLACES)} AS qua_all"
    return group_by(items, ["org", "yr"], ["count(1) AS n", all_quantity, *_cells("l_quantity")])


def _cell_sql(column: str, f: str, s: str) -> str:
    inside = f"l_returnflag = '{f}' AND l_linestatus = '{s}'"
    return (
        f"CASE WHEN count(*) FILTER ({inside}) >= {MIN_ROWS} THEN"
        f" CAST(sum(CAST({column} AS DECIMAL(18,2))) FILTER ({inside}) AS DOUBLE) END"
        f" AS {column[2:5]}_{f}{s}"
    )


WIDE_SQL = f"""wide AS (
    SELECT l_suppkey AS org, CAST(year(l_shipdate) AS VARCHAR) AS yr, count(*) AS n,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qua_all,
        {", ".join(_cell_sql("l_quantity", f, s) for f in FLAGS for s in STATUSES)}
    FROM lineitem GROUP BY ALL)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation and its state."""
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS org", "s_nationkey AS n_nationkey"
    )
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name AS state")
    return fact_join(supplier, nation, "n_nationkey").select("org", "state")


def wide_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with states: line items are aggregated before the join."""
    return fact_join(wide(spark, sf_dir), states(spark, sf_dir), "org")


STATE_SQL = (
    WIDE_SQL
    + """, stated AS (
    SELECT wide.*, n_name AS state FROM wide
    JOIN supplier ON org = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select("s_suppkey")


ROSTER_SQL = "roster AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"

FACTS = FactColumns(
    key="org",
    year="yr",
    patients=("qty_f", "qty_o"),
    minority=("qty_a", "qty_r"),
    public_insurance=("qty_a",),
    uninsured=("qty_n",),
    over_poverty=("qty_r", "qty_n"),
    other_language="qty_o",
    control=("disc_part", "price", "qty"),
    uncontrolled=("tax_part", "price", "qty"),
    cost="price",
    fte="qty_f",
    places=PLACES,
)


def sum_sql(x: str, zero: bool = True) -> str:
    """Exact sum as a double, matching the library's rule for empty sums."""
    total = f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
    return f"coalesce({total}, 0)" if zero else total


def row_sum_sql(*columns: str) -> str:
    return sum_sql(" + ".join(f"coalesce({c}, 0)" for c in columns))


def steady_sql(x: str) -> str:
    """Sum by whole parts, fractions in units of 2^-62, and what these leave, as integers."""
    unit = "4611686018427387904"
    whole = f"trunc({x})"
    scaled = f"(({x} - {whole}) * {unit}::DOUBLE)"
    rest = f"(({scaled} - trunc({scaled})) * {unit}::DOUBLE)"
    w, f, r = (f"sum(CAST(trunc({part}) AS HUGEINT))" for part in (whole, scaled, rest))
    f = f"({f} + {r} // {unit})"
    return (
        f"coalesce(CAST(CAST({w} + {f} // {unit} AS BIGINT) AS DOUBLE) + (CAST(CAST({f} % {unit} AS BIGINT) AS DOUBLE)"
        f" + CAST(CAST({r} % {unit} AS BIGINT) AS DOUBLE) / {unit}::DOUBLE) / {unit}::DOUBLE, 0)"
    )


def ratio_sql(part: str, base: str, weight: str) -> str:
    numerator = steady_sql(f"({part} / nullif({base}, 0) * {weight})")
    return f"{numerator} / nullif({sum_sql(weight, zero=False)}, 0)"


def sd_sql(x: str) -> str:
    """Sample standard deviation by sums and squares of whole hundredths."""
    units = f"CAST(round({x} * 100) AS HUGEINT)"
    total, n = f"sum({units})", f"CAST(count({x}) AS HUGEINT)"
    q = f"({total} // nullif({n}, 0))"
    r = f"({total} - {q} * {n})"
    around = f"CAST(CAST(sum({units} * {units}) - {q} * {q} * {n} - 2 * {q} * {r} AS VARCHAR) AS DOUBLE)"
    left = f"CAST(CAST({r} AS BIGINT) AS DOUBLE)"
    return f"CASE WHEN count({x}) > 1 THEN sqrt(greatest(0, {around} - {left} * {left} / count({x})) / (count({x}) - 1)) / 100 END"


def pct_sql(n: str, total: str, digits: int = 1) -> str:
    return f"round(100.0 * {n} / nullif({total}, 0), {digits})"


def signed_sql(x: str, suffix: str) -> str:
    number = f"regexp_replace(printf('%.1f', CASE WHEN {x} = 0 THEN 0.0 ELSE {x} END), '\\.0$', '')"
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {number} || '{suffix}'"


def money_sql(x: str) -> str:
    return f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


GRAIN_SQL = (
    LINES_SQL
    + f""", grain AS (
    SELECT org, yr, {row_sum_sql("qty_f", "qty_o")} AS patient_count,
        {row_sum_sql("qty_a", "qty_r")} AS minority_patient_count,
        {row_sum_sql("qty_a")} AS public_insurance_total,
        {row_sum_sql("qty_n")} AS uninsured_total,
        {row_sum_sql("qty_r", "qty_n")} AS fpl_over_100_total,
        {sum_sql("qty_o")} AS "LOE_total",
        {ratio_sql("disc_part", "price", "qty")} AS control_ratio,
        {ratio_sql("tax_part", "price", "qty")} AS uncontrolled_ratio,
        {sum_sql("price")} AS total_cost, {sum_sql("qty_f")} AS fte_total
    FROM lines GROUP BY org, yr)"""
)


def pivot_sql(value: str, prefix: str, source: str = "grain") -> str:
    cells = ", ".join(
        f"max(CASE WHEN yr = '{y}' THEN {value} END) AS {prefix}{y}" for y in (OLD, NEW)
    )
    return f"SELECT org, {cells} FROM {source} WHERE yr IN ('{OLD}', '{NEW}') GROUP BY org"


def badge_sheet(spark: SparkSession, sf_dir: str, year: str) -> DataFrame:
    """Customers with an order in the year, and their badges."""
    in_year = table(spark, sf_dir, "orders").where(
        f"o_orderdate >= '{year}-01-01' AND o_orderdate < '{int(year) + 1}-01-01'"
    )
    badges = [
        named(f"IF(bool_or(o_orderpriority = '{priority}'), 'Yes', NULL)", BADGE.format(level))
        for level, priority in LEVELS.items()
    ]
    customers = in_year.selectExpr(named("o_custkey", BADGE_KEY), "o_orderpriority")
    return group_by(customers, [BADGE_KEY], [named("count(1)", "HC Type - orders"), *badges])


def badge_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {y: badge_sheet(spark, sf_dir, y) for y in YEARS}


def badge_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey")


def _badge_year_sql(year: str) -> str:
    cells = ", ".join(
        f"CASE WHEN bool_or(o_orderpriority = '{p}') THEN 'Yes' END"
        f' AS "{BADGE.format(level)}_{year}"'
        for level, p in LEVELS.items()
    )
    return (
        f"b{year} AS (SELECT o_custkey AS k, {cells} FROM orders"
        f" WHERE year(o_orderdate) = {year} GROUP BY o_custkey)"
    )


BADGES_SQL = (
    ", ".join(_badge_year_sql(y) for y in YEARS)
    + f', badges AS (SELECT k AS "{BADGE_KEY}", * EXCLUDE (k) FROM b{YEARS[0]} '
    + " ".join(f"FULL JOIN b{y} USING (k)" for y in YEARS[1:])
    + ")"
)
BADGE_COLUMNS = [f"{BADGE.format(level)}_{y}" for level in LEVELS for y in YEARS]


# A workbook of text sheets for one year. The price sheet lacks every seventh
# organisation and the info sheet every eleventh, so the outer merge has gaps to fill.
PRICED = "{org} % 7 <> 3"
INFORMED = "{org} % 11 <> 5"
KEY = "GrantNumber"
INFO_TEXT = ("GrantNumber", "ReportingYear", "HealthCenterName", "HealthCenterState")


def _text_cells(column: str, prefix: str) -> list[str]:
    out = []
    for f in FLAGS:
        for s in STATUSES:
            inside = f"l_returnflag = '{f}' AND l_linestatus = '{s}'"
            value = f"sum(IF({inside}, CAST({column} AS DECIMAL(18,2)), NULL))"
            shown = f"IF(count_if({inside}) >= {MIN_ROWS}, CAST({value} AS STRING), '-')"
            out.append(named(shown, f"{prefix}_L{f}.{s}_Ca"))
    return out


def year_cells(spark: SparkSession, sf_dir: str, years: tuple[str, ...] = YEARS) -> DataFrame:
    """The cells of both table sheets by organisation and year, one scan for all."""
    low, high = min(years), int(max(years)) + 1
    items = (
        table(spark, sf_dir, "lineitem")
        .where(f"l_shipdate >= '{low}-01-01' AND l_shipdate < '{high}-01-01'")
        .selectExpr(
            "l_suppkey AS org", f"{YEAR_TEXT} AS yr",
            "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
        )
    )
    cells = [*_text_cells("l_quantity", "T3"), *_text_cells("l_extendedprice", "T8")]
    return group_by(items, ["org", "yr"], cells)


def workbook(spark: SparkSession, sf_dir: str, year: str, cells: DataFrame) -> dict[str, DataFrame]:
    """The sheets of one year, every cell text."""
    key = f"CAST(org AS STRING) AS {KEY}"
    of_year = cells.where(f"yr = '{year}'")

    def sheet(prefix: str) -> DataFrame:
        return of_year.selectExpr(key, "org", *[quoted(c) for c in cells.columns if c.startswith(prefix)])

    named_orgs = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS org", "s_name", "s_acctbal"
    )
    informed = named_orgs.where(INFORMED.format(org="org"))
    info = fact_join(informed, states(spark, sf_dir), "org").selectExpr(
        key,
        f"'{year}' AS ReportingYear",
        "s_name AS HealthCenterName",
        "state AS HealthCenterState",
        "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) AS FundingCHC",
    )
    return {
        "HealthCenterInfo": info,
        "Table3": sheet("T3").drop("org"),
        "Table8": sheet("T8").where(PRICED.format(org="org")).drop("org"),
    }


def stacked_sheets(spark: SparkSession, sf_dir: str, cells: DataFrame, years: tuple[str, ...] = YEARS) -> dict[str, DataFrame]:
    """The sheets of all years stacked, as a scan over the workbooks gives them."""
    key = f"CAST(org AS STRING) AS {KEY}"

    def sheet(prefix: str, rows: DataFrame) -> DataFrame:
        return rows.selectExpr(key, f"yr AS {WORKBOOK}", *[quoted(c) for c in cells.columns if c.startswith(prefix)])

    named_orgs = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS org", "s_name", "s_acctbal")
    informed = fact_join(named_orgs.where(INFORMED.format(org="org")), states(spark, sf_dir), "org")
    each = f"explode(array({', '.join(f"'{y}'" for y in years)})) AS {WORKBOOK}"
    info = informed.selectExpr("*", each).selectExpr(
        key,
        WORKBOOK,
        f"{WORKBOOK} AS ReportingYear",
        "s_name AS HealthCenterName",
        "state AS HealthCenterState",
        "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) AS FundingCHC",
    )
    return {
        "HealthCenterInfo": info,
        "Table3": sheet("T3", cells),
        "Table8": sheet("T8", cells.where(PRICED.format(org="org"))),
    }


def workbook_sql(year: str) -> str:
    def cells(column: str, prefix: str) -> str:
        out = []
        for f in FLAGS:
            for s in STATUSES:
                inside = f"l_returnflag = '{f}' AND l_linestatus = '{s}'"
                out.append(
                    f"CASE WHEN count(*) FILTER ({inside}) >= {MIN_ROWS} THEN"
                    f" CAST(sum(CAST({column} AS DECIMAL(18,2))) FILTER ({inside}) AS DOUBLE) END"
                    f' AS "{prefix}_L{f}.{s}_Ca"'
                )
        return ", ".join(out)

    return f"""
    i{year} AS (SELECT CAST(s_suppkey AS VARCHAR) AS "{KEY}", s_name AS "HealthCenterName",
        n_name AS "HealthCenterState", s_acctbal AS "FundingCHC"
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE {INFORMED.format(org="s_suppkey")}),
    t{year} AS (SELECT CAST(l_suppkey AS VARCHAR) AS "{KEY}", {cells("l_quantity", "T3")}
        FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY l_suppkey),
    p{year} AS (SELECT CAST(l_suppkey AS VARCHAR) AS "{KEY}", {cells("l_extendedprice", "T8")}
        FROM lineitem WHERE year(l_shipdate) = {year} AND {PRICED.format(org="l_suppkey")} GROUP BY l_suppkey),
    y{year} AS (SELECT *, '{year}' AS "ReportingYear" FROM i{year}
        FULL JOIN t{year} USING ("{KEY}") FULL JOIN p{year} USING ("{KEY}")
        WHERE CAST("{KEY}" AS BIGINT) IN (SELECT s_suppkey FROM roster))"""


def text_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(spark, sf_dir).selectExpr(f"CAST(s_suppkey AS STRING) AS {KEY}")
