"""Aggregations, profiles, crosstabs, badges and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterfold.operators import badges as b
from rosterfold.operators import measures as m
from rosterfold.operators.crosstab import (
    count_percent_labels,
    crosstab,
    row_percentages,
    with_row_total,
)
from rosterfold.operators.distribution import (
    histogram_bins,
    share_of_universe,
    six_number_summary,
)
from rosterfold.operators.profile import profile_numeric, profile_text
from rosterfold.operators.roster import roster_filter
from rosterfold.plans.facts import org_year_grain
from rosterfold.verification import standin as s
from rosterfold.verification.registry import registered

P = s.PLACES


@registered(
    "yearly_sum", f"WITH {s.LINES_SQL} SELECT yr, {s.sum_sql('qty_f')} AS total FROM lines GROUP BY yr"
)
def yearly_sum(spark, sf):
    return m.summarise(s.lines(spark, sf), "yr", [m.total("total", "qty_f", P)])


YEARLY_ROWSUM_SQL = f"""WITH {s.LINES_SQL}
    SELECT yr, {s.row_sum_sql("qty_f", "qty_o")} AS total FROM lines GROUP BY yr"""


@registered("yearly_rowsum", YEARLY_ROWSUM_SQL)
def yearly_rowsum(spark, sf):
    return m.summarise(s.lines(spark, sf), "yr", [m.row_total("total", ["qty_f", "qty_o"], P)])


@registered(
    "multi_measure_sum",
    f"""WITH {s.LINES_SQL} SELECT yr, {s.sum_sql("qty_a")} AS a, {s.sum_sql("qty_n")} AS n,
    {s.sum_sql("qty_r")} AS r, {s.sum_sql("qty")} AS everything FROM lines GROUP BY yr""",
)
def multi_measure_sum(spark, sf):
    columns = {"a": "qty_a", "n": "qty_n", "r": "qty_r", "everything": "qty"}
    return m.summarise(s.lines(spark, sf), "yr", [m.total(n, c, P) for n, c in columns.items()])


def _cells_sql(aggregate: str) -> str:
    return ", ".join(f'{aggregate.format(f"qua_{c}")} AS "qua_{c}_out"' for c in s.CELLS)


@registered(
    "state_distribution",
    f"WITH {s.STATE_SQL} SELECT yr, state, {_cells_sql(s.sum_sql('{}'))} FROM stated GROUP BY yr, state",
)
def state_distribution(spark, sf):
    cells = [m.total(f"qua_{c}_out", f"qua_{c}", P) for c in s.CELLS]
    return m.summarise(s.wide_with_state(spark, sf), ["yr", "state"], cells)


@registered("reported_count", f"WITH {s.WIDE_SQL} SELECT yr, {_cells_sql('count({})')} FROM wide GROUP BY yr")
def reported_count(spark, sf):
    cells = [m.reported(f"qua_{c}_out", f"qua_{c}") for c in s.CELLS]
    return m.summarise(s.wide(spark, sf), "yr", cells)


@registered(
    "suppressed_count",
    f"WITH {s.WIDE_SQL} SELECT yr, {_cells_sql('count(*) - count({})')} FROM wide GROUP BY yr",
)
def suppressed_count(spark, sf):
    cells = [m.suppressed(f"qua_{c}_out", f"qua_{c}") for c in s.CELLS]
    return m.summarise(s.wide(spark, sf), "yr", cells)


_INVARIANT = ", ".join(
    f'count("qua_{c}") AS "qua_{c}_reported", count(*) - count("qua_{c}") AS "qua_{c}_suppressed",'
    f' count("qua_{c}") + count(*) FILTER ("qua_{c}" IS NULL) = count(*) AS "qua_{c}_complete"'
    for c in s.CELLS
)


@registered(
    "suppression_invariant",
    f"WITH {s.WIDE_SQL} SELECT yr, count(*) AS members, {_INVARIANT} FROM wide GROUP BY yr",
)
def suppression_invariant(spark, sf):
    return m.suppression_check(s.wide(spark, sf), "yr", [f"qua_{c}" for c in s.CELLS])


def mean_sql(x: str) -> str:
    return f"{s.sum_sql(x, zero=False)} / nullif(count({x}), 0)"


@registered(
    "yearly_mean",
    f"WITH {s.WIDE_SQL} SELECT yr, {mean_sql('qua_AF')} AS mean_cell FROM wide GROUP BY yr",
)
def yearly_mean(spark, sf):
    return m.summarise(s.wide(spark, sf), "yr", [m.mean("mean_cell", "qua_AF", P)])


_MEANS = ", ".join(f'round({mean_sql(f"qua_{c}")}, 2) AS "mean_{c}"' for c in s.CELLS)


@registered("mean_table", f"WITH {s.WIDE_SQL} SELECT yr, {_MEANS} FROM wide GROUP BY yr")
def mean_table(spark, sf):
    means = [m.mean(f"mean_{c}", f"qua_{c}", P, digits=2) for c in s.CELLS]
    return m.summarise(s.wide(spark, sf), "yr", means)


_RATIO = s.ratio_sql("disc_part", "price", "qty")


@registered("weighted_ratio", f"WITH {s.LINES_SQL} SELECT yr, {_RATIO} AS ratio FROM lines GROUP BY yr")
def weighted_ratio(spark, sf):
    ratio = m.weighted_ratio("ratio", "disc_part", "price", "qty", P)
    return m.summarise(s.lines(spark, sf), "yr", [ratio])


_SPARSE = "CASE WHEN l_discount > 0.02 THEN l_extendedprice END"


@registered(
    "weighted_ratio_strict",
    f"""WITH cells AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS yr, l_quantity AS w,
    l_extendedprice * l_tax AS part, {_SPARSE} AS base FROM lineitem)
    SELECT yr, {s.ratio_sql("part", "base", "w")} AS loose, {s.steady_sql("(part / base * w)")}
    / nullif(CAST(sum(CAST(CASE WHEN base IS NOT NULL THEN w END AS DECIMAL(18,2))) AS DOUBLE), 0) AS strict
    FROM cells GROUP BY yr""",
)
def weighted_ratio_strict(spark, sf):
    cells = s.table(spark, sf, "lineitem").selectExpr(
        f"{s.YEAR_TEXT} AS yr",
        "l_quantity AS w",
        "l_extendedprice * l_tax AS part",
        f"{_SPARSE} AS base",
    )
    return m.summarise(
        cells,
        "yr",
        [
            m.weighted_ratio("loose", "part", "base", "w", P),
            m.weighted_ratio("strict", "part", "base", "w", P, strict=True),
        ],
    )


@registered(
    "weighted_ratio_by_org",
    f"WITH {s.LINES_SQL} SELECT org, yr, {_RATIO} AS ratio FROM lines GROUP BY org, yr",
)
def weighted_ratio_by_org(spark, sf):
    ratio = m.weighted_ratio("ratio", "disc_part", "price", "qty", P)
    return m.summarise(s.lines(spark, sf), ["org", "yr"], [ratio])


def _roster_badges(spark, sf):
    merged = b.merge_badges(s.badge_sheets(spark, sf), s.BADGE_KEY)
    return roster_filter(merged, s.BADGE_KEY, s.badge_roster(spark, sf))


_ROSTER_BADGES_SQL = (
    s.BADGES_SQL
    + f""", mine AS (SELECT * FROM badges
    WHERE "{s.BADGE_KEY}" IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))"""
)


def _yes(columns) -> str:
    return " + ".join(f"count(*) FILTER (\"{c}\" = 'Yes')" for c in columns)


def _of_year(year: str) -> list[str]:
    return [c for c in s.BADGE_COLUMNS if c.endswith(year)]


@registered(
    "badge_count",
    f"""WITH {_ROSTER_BADGES_SQL}
    SELECT {", ".join(f'{_yes([c])} AS "{c}"' for c in s.BADGE_COLUMNS)} FROM mine""",
)
def badge_count(spark, sf):
    return b.badge_count(_roster_badges(spark, sf), s.BADGE_COLUMNS)


@registered(
    "badge_cells_by_year",
    f"""WITH {_ROSTER_BADGES_SQL}
    SELECT {", ".join(f'{_yes(_of_year(y))} AS member_badges_{y}' for y in s.YEARS)} FROM mine""",
)
def badge_cells_by_year(spark, sf):
    return b.badge_cells(_roster_badges(spark, sf), s.YEARS, "member_badges_")


@registered(
    "badge_cells_all",
    f"""WITH {s.BADGES_SQL}
    SELECT {", ".join(f'{_yes(_of_year(y))} AS total_badges_{y}' for y in s.YEARS)} FROM badges""",
)
def badge_cells_all(spark, sf):
    merged = b.merge_badges(s.badge_sheets(spark, sf), s.BADGE_KEY)
    return b.badge_cells(merged, s.YEARS, "total_badges_")


def _any_yes(year: str) -> str:
    return " OR ".join(f"\"{c}\" = 'Yes'" for c in _of_year(year))


@registered(
    "badge_holders",
    f"""WITH {s.BADGES_SQL}
    SELECT {", ".join(f"count(*) FILTER ({_any_yes(y)}) AS holders_{y}" for y in s.YEARS)}
    FROM badges""",
)
def badge_holders(spark, sf):
    merged = b.merge_badges(s.badge_sheets(spark, sf), s.BADGE_KEY)
    return b.badge_holders(merged, s.YEARS)


def _text_profile_sql(x: str, by: str, source: str) -> str:
    return f"""SELECT {by}, count(*) - count({x}) AS n_missing, count({x}) / count(*) AS complete_rate,
    CAST(min(length({x})) AS INTEGER) AS min_length, CAST(max(length({x})) AS INTEGER) AS max_length,
    count(*) FILTER ({x} = '') AS empty, count(DISTINCT {x}) AS n_unique,
    count(*) FILTER (regexp_full_match({x}, '\\s+')) AS whitespace FROM {source} GROUP BY {by}"""


@registered("profile_text", _text_profile_sql("text", "lang", "documents"))
def text_profile(spark, sf):
    return profile_text(s.table(spark, sf, "documents"), "text", "lang")


@registered(
    "profile_text_by_year",
    f"""WITH keys AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS yr,
    CASE WHEN l_discount > 0 THEN CAST(l_suppkey AS VARCHAR) END AS k FROM lineitem)
    {_text_profile_sql("k", "yr", "keys")}""",
)
def text_profile_by_year(spark, sf):
    keys = s.table(spark, sf, "lineitem").selectExpr(
        f"{s.YEAR_TEXT} AS yr", "IF(l_discount > 0, CAST(l_suppkey AS STRING), NULL) AS k"
    )
    return profile_text(keys, "k", "yr")


def _numeric_profile_sql(x: str, by: str, source: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    over = " + ".join(f"CAST({x} > lo + (hi - lo) / 5 * {k} AS INTEGER)" for k in range(1, 5))
    counts = ", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in range(5))
    top = "greatest(b0, b1, b2, b3, b4)"
    bars = " || ".join(
        f"substr('▁▂▃▅▆▇', CAST(greatest(1, ceil(b{k} * 6 / {top})) AS INTEGER), 1)" for k in range(5)
    )
    same = " AND ".join(f"m.{k} = t.{k}" for k in keys)
    return f"""m AS (SELECT {by}, count(*) - count({x}) AS n_missing,
        count({x}) / count(*) AS complete_rate,
        CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / nullif(count({x}), 0) AS mean,
        {s.sd_sql(x)} AS sd, min({x}) AS lo, quantile_cont({x}, 0.25) AS p25,
        quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS hi
        FROM {source} GROUP BY {by}),
    h AS (SELECT {", ".join("m." + k for k in keys)}, {counts} FROM
        (SELECT m.*, CASE WHEN lo = hi THEN 2 WHEN {x} IS NOT NULL THEN {over} END AS bin
        FROM {source} t JOIN m ON {same}) m GROUP BY {by})
    SELECT {by}, n_missing, complete_rate, mean, sd, lo AS p0, p25, p50, p75, hi AS p100,
        CASE WHEN {top} > 0 THEN {bars} END AS hist FROM m JOIN h USING ({by})"""


@registered(
    "profile_numeric",
    f"WITH {s.LINES_SQL}, {_numeric_profile_sql('price', 'yr', 'lines')}",
)
def numeric_profile(spark, sf):
    return profile_numeric(s.lines(spark, sf), "price", "yr", P)


@registered(
    "profile_numeric_two_key",
    f"WITH {s.LINES_SQL}, {_numeric_profile_sql('qty_f', 'org, yr', 'lines')}",
)
def numeric_profile_two_key(spark, sf):
    return profile_numeric(s.lines(spark, sf), "qty_f", ["org", "yr"], P)


def _count_sql(wrap: str = "{}") -> str:
    return ", ".join(
        wrap.format(f"count(*) FILTER (state = '{v}')") + f' AS "{v}"' for v in s.STATES
    )


@registered("crosstab", f"WITH {s.STATE_SQL} SELECT yr, {_count_sql()} FROM stated GROUP BY yr")
def year_by_state(spark, sf):
    return crosstab(s.wide_with_state(spark, sf), "yr", "state", s.STATES)


@registered(
    "crosstab_totals",
    f'WITH {s.STATE_SQL} SELECT yr, {_count_sql()}, count(*) AS "Total" FROM stated GROUP BY yr',
)
def year_by_state_totals(spark, sf):
    return with_row_total(crosstab(s.wide_with_state(spark, sf), "yr", "state", s.STATES), "yr")


@registered(
    "crosstab_row_pct",
    f"""WITH {s.STATE_SQL} SELECT yr, {_count_sql("({}) / count(*)")},
    count(*) / count(*) AS "Total" FROM stated GROUP BY yr""",
)
def year_by_state_shares(spark, sf):
    counts = crosstab(s.wide_with_state(spark, sf), "yr", "state", s.STATES, total="Total")
    return row_percentages(counts, "yr")


def _label_sql(n: str) -> str:
    return f"CAST({n} AS VARCHAR) || ' (' || printf('%.1f', 100.0 * ({n}) / count(*)) || '%)'"


_LABELS = ", ".join(
    _label_sql(f"count(*) FILTER (state = '{v}')") + f' AS "{v}"' for v in s.STATES
)


@registered(
    "crosstab_labels",
    f"""WITH {s.STATE_SQL} SELECT yr, {_LABELS}, {_label_sql("count(*)")} AS "Total"
    FROM stated GROUP BY yr""",
)
def year_by_state_labels(spark, sf):
    counts = crosstab(s.wide_with_state(spark, sf), "yr", "state", s.STATES, total="Total")
    return count_percent_labels(counts, "yr")


_PARTS = [f"qua_{c}" for c in s.CELLS]


@registered(
    "reconcile_total",
    f"""WITH {s.WIDE_SQL} SELECT yr, {s.sum_sql("qua_all")} AS reported_total,
    {s.row_sum_sql(*_PARTS)} AS component_total,
    CAST(sum(CAST({" + ".join(f"coalesce({c}, 0)" for c in _PARTS)} - qua_all AS DECIMAL(18,2)))
    AS DOUBLE) AS difference FROM wide GROUP BY yr""",
)
def reconcile(spark, sf):
    return m.reconcile_total(s.wide(spark, sf), "yr", "qua_all", _PARTS, P)


@registered(
    "share_of_universe",
    f"""WITH {s.WIDE_SQL}, {s.ROSTER_SQL}, both_ AS (SELECT yr,
    {s.sum_sql("CASE WHEN s_suppkey IS NOT NULL THEN qua_all END")} AS patients_roster,
    {s.sum_sql("qua_all")} AS patients_universe,
    count(s_suppkey) AS members_roster, count(*) AS members_universe
    FROM wide LEFT JOIN roster ON org = s_suppkey GROUP BY yr)
    SELECT *, {s.pct_sql("patients_roster", "patients_universe", 2)} AS patients_pct,
    {s.pct_sql("members_roster", "members_universe", 2)} AS members_pct FROM both_""",
)
def share(spark, sf):
    measures = [m.total("patients", "qua_all", P), m.rows("members")]
    return share_of_universe(s.wide(spark, sf), "org", s.roster(spark, sf), "yr", measures)


@registered(
    "six_number_summary",
    """SELECT min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.5) AS median,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS mean,
    quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS max FROM lineitem""",
)
def six_numbers(spark, sf):
    return six_number_summary(s.table(spark, sf, "lineitem"), "l_extendedprice", P)


@registered(
    "histogram_bins",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT least(CAST(floor(15 * (o_totalprice - lo) / (hi - lo)) AS BIGINT) + 1, 15) AS bin,
        count(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, lo + (hi - lo) / 15 * (i - 1) AS lower,
        CASE WHEN i = 15 THEN hi ELSE lo + (hi - lo) / 15 * i END AS upper, coalesce(n, 0) AS n
    FROM range(1, 16) r(i) CROSS JOIN e LEFT JOIN b ON bin = i""",
)
def histogram(spark, sf):
    return histogram_bins(s.table(spark, sf, "orders"), "o_totalprice", 15)


@registered(
    "org_year_grain",
    f"WITH {s.GRAIN_SQL} SELECT * FROM grain",
)
def grain(spark, sf):
    return org_year_grain(s.lines(spark, sf), s.FACTS)


@registered(
    "weighted_ratio_small_terms",
    f"""WITH small AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS yr, l_tax * 1e-9::DOUBLE AS part,
    l_extendedprice AS base, l_quantity AS w FROM lineitem)
    SELECT yr, {s.ratio_sql("part", "base", "w")} AS ratio FROM small GROUP BY yr""",
)
def weighted_ratio_small_terms(spark, sf):
    small = s.table(spark, sf, "lineitem").selectExpr(
        f"{s.YEAR_TEXT} AS yr", "l_tax * 1e-9D AS part", "l_extendedprice AS base", "l_quantity AS w"
    )
    ratio = m.weighted_ratio("ratio", "part", "base", "w", P)
    return m.summarise(small, "yr", [ratio])


_STATE_CELL = """CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey = 4 THEN 'NA_' ELSE n_name END"""


@registered(
    "crosstab_missing_values",
    f"""WITH c AS (SELECT n_regionkey AS region, {_STATE_CELL} AS cell FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT region, count(*) FILTER (cell IS NULL) AS "NA__", count(*) FILTER (cell = 'NA_') AS "NA_",
    count(*) FILTER (cell = 'NATION_0') AS "NATION_0", count(*) AS "Total" FROM c GROUP BY region""",
)
def crosstab_missing_values(spark, sf):
    cells = (
        s.table(spark, sf, "lineitem")
        .join(s.table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(s.table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
        .selectExpr("n_regionkey AS region", f"{_STATE_CELL} AS cell")
    )
    return crosstab(cells, "region", "cell", [None, "NA_", "NATION_0"], total="Total")


def _catalogue() -> list[tuple[m.Measure, str]]:
    """A report's worth of measures over the wide table, each with its SQL."""
    out = []
    for c in s.CELLS:
        x = f"qua_{c}"
        out += [
            (m.total(f"total_{c}", x, P), s.sum_sql(x)),
            (m.mean(f"mean_{c}", x, P), mean_sql(x)),
            (m.reported(f"reported_{c}", x), f"count({x})"),
            (m.suppressed(f"suppressed_{c}", x), f"count(*) - count({x})"),
            (
                m.weighted_ratio(f"ratio_{c}", x, "qua_all", "n", P),
                s.ratio_sql(x, "qua_all", "n"),
            ),
        ]
    for f in s.FLAGS:
        pair = [f"qua_{f}{t}" for t in s.STATUSES]
        out.append((m.row_total(f"rows_{f}", pair, P), s.row_sum_sql(*pair)))
    return out


CATALOGUE = [measure for measure, _ in _catalogue()]


@registered(
    "fused_measures",
    f"""WITH {s.WIDE_SQL}
    SELECT yr, {", ".join(f'{sql} AS "{x.name}"' for x, sql in _catalogue())} FROM wide GROUP BY yr""",
)
def fused_measures(spark, sf):
    return m.summarise(s.wide(spark, sf), "yr", CATALOGUE)


@registered(
    "measures_by_grain",
    f"""WITH {s.STATE_SQL} SELECT yr, state, CAST(CASE WHEN grouping(yr) = 1 THEN 2 WHEN grouping(state) = 1 THEN 0 ELSE 1 END AS INTEGER) AS grain,
    {s.sum_sql("qua_all")} AS patients, count(*) AS members, count(*) - count("qua_AF") AS hidden
    FROM stated GROUP BY GROUPING SETS ((yr), (yr, state), ())""",
)
def measures_by_grain(spark, sf):
    """Tables by year, by year and state and of everything from one aggregation."""
    patients, members, hidden = m.total("patients", "qua_all", P), m.rows("members"), m.suppressed("hidden", "qua_AF")
    tables = {"yearly": ("yr", [patients, members]), "states": (["yr", "state"], [hidden, patients]), "all": ([], [members])}
    found = m.grouping_sets(s.wide_with_state(spark, sf), tables)
    return found.selectExpr("yr", "state", "__grain AS grain", "__m0 AS patients", "__m1 AS members", "__m2 AS hidden")
