"""Sources, sinks, filters, projections and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterfold.functions.columns import group_by
from rosterfold.functions.labels import money_label
from rosterfold.functions.numbers import exact_sum, safe_div
from rosterfold.operators.badges import merge_badges
from rosterfold.operators.change import growth_label
from rosterfold.operators.checks import row_count_check
from rosterfold.operators.measures import row_total, rows, summarise, total
from rosterfold.operators.merge import fact_join, outer_merge, stack_years
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
from rosterfold.operators.roster import key_cleanup, period_filter, roster_filter
from rosterfold.plans.load import load_all_years, load_stacked, load_year
from rosterfold.sources.pinning import pinned, shared_folder
from rosterfold.sources.sheets import roster_sheet, scan_sheet, scan_text_sheet, year_registry
from rosterfold.sources.sinks import write_report, write_stacked
from rosterfold.verification import standin as s
from rosterfold.verification.registry import registered


@registered(
    "sheet_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
)
def sheet_scan(spark, sf):
    return scan_sheet(
        spark, sf, "orders", columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    )


@registered(
    "year_registry",
    """SELECT CAST(year(l_shipdate) AS VARCHAR) AS yr, count(*) AS n,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY 1""",
)
def registry_of_years(spark, sf):
    """Each year's lines are written under a folder of their own and found through the registry."""
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    files = year_registry(root, s.YEARS, pattern="{root}/H80{year}")
    items = scan_sheet(spark, sf, "lineitem", columns=["l_shipdate", "l_suppkey", "l_quantity"])
    for year, path in files.items():
        of_year = items.where(f"l_shipdate >= '{year}-01-01' AND l_shipdate < '{int(year) + 1}-01-01'")
        write_report(of_year, f"{path}/Lines.parquet")
    parts = [
        scan_sheet(spark, path, "Lines", columns=["l_quantity"]).selectExpr(f"'{year}' AS yr", "l_quantity")
        for year, path in files.items()
    ]
    return summarise(stack_years(parts), "yr", [rows("n"), total("qty", "l_quantity", s.PLACES)])


@registered(
    "csv_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'priority ' || o_orderpriority || chr(10) || '"of" '
    || o_orderstatus AS note FROM orders""",
)
def csv_scan(spark, sf):
    """Cells with line breaks, quotes and commas through a CSV sheet under an explicit schema."""
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    notes = s.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS o_orderkey",
        """concat('priority ', o_orderpriority, '\\n', '"of" ', o_orderstatus) AS note""",
    )
    write_report(notes, f"{root}/Notes.csv", "csv")
    return scan_text_sheet(spark, f"{root}/Notes.csv", ["o_orderkey", "note"])


@registered(
    "roster_sheet",
    f"""WITH {s.ROSTER_SQL} SELECT l_suppkey, l_partkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM roster)""",
)
def sheet_of_roster(spark, sf):
    return roster_sheet(spark, sf, "lineitem", "l_suppkey", s.roster(spark, sf), [2, 4, 5])


@registered(
    "load_year",
    f"""WITH {s.ROSTER_SQL}, {s.workbook_sql(s.NEW)} SELECT * FROM y{s.NEW}""",
)
def one_year(spark, sf):
    return load_year(
        s.workbook(spark, sf, s.NEW, s.year_cells(spark, sf, (s.NEW,))), s.NEW, s.KEY, s.INFO_TEXT, roster=s.text_roster(spark, sf)
    )


def _all_years(spark, sf):
    sheets = s.stacked_sheets(spark, sf, s.year_cells(spark, sf))
    return load_stacked(sheets, s.KEY, s.INFO_TEXT, roster=s.text_roster(spark, sf))


def _year_by_year(spark, sf):
    """The same years as workbooks of their own, stacked sheet by sheet."""
    cells = pinned(s.year_cells(spark, sf))
    workbooks = {y: s.workbook(spark, sf, y, cells) for y in s.YEARS}
    return load_all_years(workbooks, s.KEY, s.INFO_TEXT, roster=s.text_roster(spark, sf))


_ALL_YEARS_SQL = f"""WITH {s.ROSTER_SQL}, {", ".join(s.workbook_sql(y) for y in s.YEARS)}
    {" UNION ALL BY NAME ".join(f"SELECT * FROM y{y}" for y in s.YEARS)}"""


@registered("load_all_years", _ALL_YEARS_SQL)
def all_years(spark, sf):
    return _all_years(spark, sf)


@registered("load_workbooks", _ALL_YEARS_SQL)
def workbooks(spark, sf):
    return _year_by_year(spark, sf)


@registered("report_sink", f"WITH {s.WIDE_SQL} SELECT * FROM wide")
def report_sink(spark, sf):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_stacked(s.wide(spark, sf), path, "yr")
    # the year comes back from the directory name; it is text, not a number
    return spark.read.schema(s.wide(spark, sf).schema).parquet(path)


@registered(
    "row_count_check",
    f"""WITH {s.WIDE_SQL} SELECT (SELECT count(*) FROM wide) AS n_rows,
    (SELECT count(*) * {len(s.YEARS)} FROM supplier) AS expected,
    (SELECT count(*) FROM wide) = (SELECT count(*) * {len(s.YEARS)} FROM supplier) AS as_expected""",
)
def count_check(spark, sf):
    """An organisation that misses a year would show."""
    expected = s.table(spark, sf, "supplier").select(F.explode(F.array(*map(F.lit, s.YEARS))))
    return row_count_check(s.wide(spark, sf), expected)


@registered(
    "roster_literal",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5, 8)",
)
def on_literal_roster(spark, sf):
    items = scan_sheet(spark, sf, "lineitem", columns=["l_orderkey", "l_linenumber", "l_suppkey"])
    return roster_filter(items, "l_suppkey", [1, 2, 3, 5, 8])


_CHANGE = "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal / 100, 1) END"


@registered(
    "label_forms",
    f"""SELECT s_suppkey, coalesce({s.signed_sql(_CHANGE, '% since 1997')}, 'NA% since 1997') AS growth,
    '$' || lpad(format('{{:,}}', CAST(round_even(abs(s_acctbal), 0) AS BIGINT)), 9, ' ') AS amount FROM supplier""",
)
def label_forms(spark, sf):
    """Labels with a text for missing numbers, and amounts aligned to a width."""
    return s.table(spark, sf, "supplier").selectExpr(
        "s_suppkey",
        f"{growth_label(_CHANGE, '1997', na_text='NA')} AS growth",
        f"{money_label('abs(s_acctbal)', '9')} AS amount",
    )


@registered(
    "roster_filter",
    f"""WITH {s.ROSTER_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice
    FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM roster)""",
)
def on_roster(spark, sf):
    items = scan_sheet(
        spark, sf, "lineitem", columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    )
    return roster_filter(items, "l_suppkey", s.roster(spark, sf))


_RAW_KEY_SQL = """raw AS (SELECT CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN '-,'
    ELSE CAST(l_suppkey AS VARCHAR) END AS k, l_quantity FROM lineitem)"""


@registered(
    "key_cleanup",
    f"WITH {_RAW_KEY_SQL} SELECT k, l_quantity FROM raw WHERE k IS NOT NULL AND k <> '-,'",
)
def cleaned_keys(spark, sf):
    raw = s.table(spark, sf, "lineitem").selectExpr(
        """CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN '-,'
        ELSE CAST(l_suppkey AS STRING) END AS k""",
        "l_quantity",
    )
    return key_cleanup(raw, "k")


@registered("named_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def named(spark, sf):
    return named_projection(
        s.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderkey"]
    )


@registered(
    "positional_projection",
    """SELECT l_suppkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount
    FROM lineitem""",
)
def positional(spark, sf):
    return positional_projection(s.table(spark, sf, "lineitem"), "l_suppkey", range(2, 8))


@registered(
    "drop_by_prefix",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def dropped(spark, sf):
    return drop_by_prefix(s.table(spark, sf, "lineitem"), "L_LINE", "l_ship", "l_return")


@registered("select_rename", 'SELECT s_suppkey AS "Grant Number", s_name AS "%name" FROM supplier')
def renamed(spark, sf):
    return select_rename(
        s.table(spark, sf, "supplier"), {"Grant Number": "s_suppkey", "%name": "s_name"}
    )


@registered(
    "suffix_columns",
    """SELECT o_custkey, o_orderkey AS "o_orderkey_2022", o_orderstatus AS "o_orderstatus_2022",
    o_totalprice AS "o_totalprice_2022", o_orderpriority AS "o_orderpriority_2022" FROM orders""",
)
def suffixed(spark, sf):
    orders = drop_by_prefix(s.table(spark, sf, "orders"), "o_orderdate")
    return suffix_columns(orders, "_2022", "o_custkey")


@registered(
    "reorder_columns",
    'SELECT l_tax, l_quantity, l_suppkey, l_extendedprice AS "Total" FROM lineitem',
)
def reordered(spark, sf):
    items = s.table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "Total")
    return named_projection(items, ["l_tax", "l_quantity", "l_suppkey", "Total"])


@registered(
    "period_filter",
    f"WITH {s.LINES_SQL} SELECT org, yr, qty FROM lines WHERE yr IN ('{s.OLD}', '{s.NEW}')",
)
def of_period(spark, sf):
    lines = s.lines(spark, sf, (s.OLD, s.NEW))
    return period_filter(lines, "yr", s.OLD, s.NEW).select("org", "yr", "qty")


@registered(
    "select_by_suffix",
    "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem",
)
def by_suffix(spark, sf):
    return select_by_suffix(s.table(spark, sf, "lineitem"), "KEY")


@registered(
    "round_numeric",
    f"""WITH {s.WIDE_SQL} SELECT org, yr, round(100.0 * "qua_AF" / qua_all, 2) AS share_a,
    round(100.0 * "qua_NO" / qua_all, 2) AS share_n FROM wide""",
)
def rounded(spark, sf):
    w = s.wide(spark, sf)
    shares = w.selectExpr(
        "org",
        "yr",
        f"{safe_div('100.0D * qua_AF', 'qua_all')} AS share_a",
        f"{safe_div('100.0D * qua_NO', 'qua_all')} AS share_n",
    )
    return round_numeric(shares, 2, skip=["org"])


@registered(
    "column_set_dedup",
    f"WITH {s.LINES_SQL} SELECT yr, {s.sum_sql('qty_f')} AS total FROM lines GROUP BY yr",
)
def column_set(spark, sf):
    return summarise(
        s.lines(spark, sf), "yr", [row_total("total", ["qty_f", "qty_f"], s.PLACES)]
    )


@registered(
    "coerce_types",
    """SELECT CAST(l_suppkey AS VARCHAR) AS org, CASE WHEN l_discount > 0 THEN l_quantity END AS m1,
    CASE WHEN l_tax > 0 THEN l_extendedprice END AS m2, CAST(l_linenumber AS DOUBLE) AS m3
    FROM lineitem""",
)
def coerced(spark, sf):
    raw = s.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS org",
        "IF(l_discount > 0, CAST(l_quantity AS STRING), '-') AS m1",
        """IF(l_tax > 0, CAST(l_extendedprice AS STRING),
        concat(CAST(l_linenumber AS STRING), 'd')) AS m2""",
        "l_linenumber AS m3",
    )
    return coerce_types(raw, ["org"])


@registered(
    "coerce_types_all",
    """SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, * EXCLUDE (l_suppkey, l_returnflag, l_linestatus,
    l_shipdate, l_orderkey, l_partkey, l_linenumber), CAST(l_orderkey AS DOUBLE) AS l_orderkey,
    CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
    CAST(NULL AS DOUBLE) AS l_returnflag, CAST(NULL AS DOUBLE) AS l_linestatus,
    CAST(epoch(l_shipdate) AS DOUBLE) AS l_shipdate FROM lineitem""",
)
def coerced_all(spark, sf):
    return coerce_types(s.table(spark, sf, "lineitem"), ["l_suppkey"])


@registered(
    "computed_columns",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
    l_extendedprice / nullif(l_quantity, 0) * 2 AS doubled FROM lineitem""",
)
def computed(spark, sf):
    added = computed_columns(
        s.table(spark, sf, "lineitem"),
        {
            "unit_price": safe_div("l_extendedprice", "l_quantity"),
            "doubled": "unit_price * 2",
        },
    )
    return added.select("l_orderkey", "l_linenumber", "unit_price", "doubled")


def _five_sheets(spark, sf):
    """Per-part sheets; each but the first lacks some parts."""
    items = s.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "part")

    def sheet(name, condition, column):
        return group_by(items.where(condition), ["part"], [f"{exact_sum(column, 2)} AS {name}"])

    return {
        "sheet1": s.table(spark, sf, "part").selectExpr("p_partkey AS part", "p_size"),
        "sheet2": sheet("qty_a", "l_returnflag = 'A'", "l_quantity"),
        "sheet3": sheet("qty_n", "l_returnflag = 'N' AND l_partkey % 5 <> 1", "l_quantity"),
        "sheet4": sheet("price_r", "l_returnflag = 'R' AND l_partkey % 7 <> 2", "l_extendedprice"),
        "sheet5": sheet("price_f", "l_linestatus = 'F'", "l_extendedprice"),
    }


def _part_sheet_sql(name, condition, column):
    return (
        f"(SELECT l_partkey AS part, {s.sum_sql(column, zero=False)} AS {name} FROM lineitem"
        f" WHERE {condition} GROUP BY 1)"
    )


_FIVE_SQL = " ".join(
    f"FULL JOIN {x} USING (part)"
    for x in (
        _part_sheet_sql("qty_a", "l_returnflag = 'A'", "l_quantity"),
        _part_sheet_sql("qty_n", "l_returnflag = 'N' AND l_partkey % 5 <> 1", "l_quantity"),
        _part_sheet_sql("price_r", "l_returnflag = 'R' AND l_partkey % 7 <> 2", "l_extendedprice"),
        _part_sheet_sql("price_f", "l_linestatus = 'F'", "l_extendedprice"),
    )
)
_MERGE_SQL = f"SELECT * FROM (SELECT p_partkey AS part, p_size FROM part) {_FIVE_SQL}"
_REPEATED_SQL = f"""WITH offered AS (SELECT CASE WHEN l_partkey % 100 = 0 THEN NULL ELSE l_partkey END AS part,
    l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL),
    sizes AS (SELECT CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE p_partkey END AS part, p_size FROM part)
    SELECT coalesce(o.part, z.part) AS part, flag, n, p_size
    FROM offered o FULL JOIN sizes z ON o.part IS NOT DISTINCT FROM z.part"""


@registered("outer_merge", _MERGE_SQL)
def merged(spark, sf):
    return outer_merge(_five_sheets(spark, sf), "part")


def chained_full_joins(spark, sf):
    """The plan that a fold of unique keys avoids, for comparison."""
    return outer_merge(_five_sheets(spark, sf), "part", unique_keys=False)


@registered("outer_merge_repeated_keys", _REPEATED_SQL)
def merged_by_joins(spark, sf):
    """Several rows of a key in a sheet, and keys that are missing in both."""
    offered = group_by(
        s.table(spark, sf, "lineitem").selectExpr(
            "IF(l_partkey % 100 = 0, NULL, l_partkey) AS part", "l_returnflag AS flag"
        ),
        ["part", "flag"],
        ["count(1) AS n"],
    )
    sizes = s.table(spark, sf, "part").selectExpr(
        "IF(p_partkey % 100 = 0, NULL, p_partkey) AS part", "p_size"
    )
    sheets = {"offered": offered, "sizes": sizes}
    return outer_merge(sheets, "part", keep_null_key=True, unique_keys=False)


_ASSORTED_SQL = f"""WITH kept AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_orderpriority AS p,
    o_orderdate AS d FROM orders),
    a AS (SELECT k, p AS first_priority FROM kept WHERE year(d) = 1996 AND o_orderkey % 40 = 0),
    b AS (SELECT k, p AS second_priority FROM kept WHERE year(d) = 1997 AND o_orderkey % 40 = 0),
    c AS (SELECT k, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY k)
    SELECT coalesce(a.k, b.k, c.k) AS k, first_priority, second_priority, n
    FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k FULL JOIN c ON coalesce(a.k, b.k) IS NOT DISTINCT FROM c.k"""


@registered("outer_merge_assorted_keys", _ASSORTED_SQL)
def merged_with_assorted_keys(spark, sf):
    """Sheets in which some keys repeat, some are blank and most occur once: only the former are joined."""
    kept = s.table(spark, sf, "orders").selectExpr(
        "IF(o_custkey % 10 = 0, NULL, o_custkey) AS k", "o_orderkey", "o_orderpriority AS p", "o_orderdate AS d"
    )
    some = kept.where("o_orderkey % 40 = 0")
    sheets = {
        "a": some.where("d >= '1996-01-01' AND d < '1997-01-01'").selectExpr("k", "p AS first_priority"),
        "b": some.where("d >= '1997-01-01' AND d < '1998-01-01'").selectExpr("k", "p AS second_priority"),
        "c": group_by(kept, ["k"], ["count(1) AS n"]),
    }
    return outer_merge(sheets, "k", keep_null_key=True, unique_keys=None)


@registered("badge_merge", f"WITH {s.BADGES_SQL} SELECT * FROM badges")
def badges(spark, sf):
    return merge_badges(s.badge_sheets(spark, sf), s.BADGE_KEY)


@registered(
    "fact_join",
    f"WITH {s.WIDE_SQL} SELECT org, yr, n, s_name FROM wide JOIN supplier ON org = s_suppkey",
)
def joined(spark, sf):
    counted = s.wide(spark, sf).select("org", "yr", "n")
    names = s.table(spark, sf, "supplier").selectExpr("s_suppkey AS org", "s_name")
    return fact_join(counted, names, "org")


@registered(
    "two_key_join",
    f"""WITH {s.LINES_SQL},
    a AS (SELECT org, yr, {s.sum_sql("qty_a")} AS public_total FROM lines GROUP BY ALL),
    b AS (SELECT org, yr, {s.row_sum_sql("qty_f", "qty_o")} AS patients FROM lines GROUP BY ALL)
    SELECT * FROM a JOIN b USING (org, yr)""",
)
def joined_on_two(spark, sf):
    lines = s.lines(spark, sf)
    public = summarise(lines, ["org", "yr"], [total("public_total", "qty_a", s.PLACES)])
    patients = summarise(lines, ["org", "yr"], [row_total("patients", ["qty_f", "qty_o"], s.PLACES)])
    return fact_join(public, patients, ["org", "yr"])


@registered(
    "stack_years",
    """SELECT o_orderkey, o_totalprice, NULL AS o_orderstatus FROM orders WHERE year(o_orderdate) = 1997
    UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE year(o_orderdate) = 1998
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE year(o_orderdate) > 1998
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE year(o_orderdate) < 1997""",
)
def stacked(spark, sf):
    orders = s.table(spark, sf, "orders")
    in_1997 = orders.where("o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'")
    in_1998 = orders.where("o_orderdate >= '1998-01-01' AND o_orderdate < '1999-01-01'")
    others = orders.where("o_orderdate >= '1999-01-01' OR o_orderdate < '1997-01-01'")
    return stack_years(
        [
            in_1997.select("o_orderkey", "o_totalprice"),
            in_1998.select("o_orderstatus", "o_orderkey"),
            others.select("o_totalprice", "o_orderkey", "o_orderstatus"),
        ]
    )
