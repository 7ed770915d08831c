"""Catalog: profiling, grouping, filters, limits, monthly summary."""

from __future__ import annotations


from pyspark.sql import functions as F

from capsight.operators import filters as fl
from capsight.operators import groups as gr
from capsight.operators import monthly as mo
from capsight.operators import profile as pf
from capsight.plans.base import nn, register, rounded, view

VISIT_COLS = ["building", "visit_date", "attendees", "capacity", "l_orderkey", "l_linenumber",
              "l_partkey", "l_suppkey"]
NUM_COLS = ["attendees", "capacity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY = ["visit_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# -- A1 / A2 ----------------------------------------------------------------------
@register("overview", "SELECT count(*) AS rows, 8::BIGINT AS columns, ("
          + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in VISIT_COLS)
          + ") AS missing FROM visits_null", views=("visits_null",))
def q_overview(spark, sf):
    return pf.overview(view(spark, sf, "visits_null"))


@register("overview_nan", "SELECT count(*) AS rows, 8::BIGINT AS columns, ("
          + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in VISIT_COLS)
          + ") AS missing FROM visits_nan", views=("visits_nan",))
def q_overview_nan(spark, sf):
    return pf.overview(view(spark, sf, "visits_nan"))


_WIDTH = {"visit_date": 8, "attendees": 8, "capacity": 8, "l_orderkey": 8, "l_linenumber": 4,
          "l_partkey": 8, "l_suppkey": 8}


@register("data_size", "SELECT bytes, round(bytes / 1024.0, 6) AS kb FROM (SELECT CAST("
          "coalesce(sum(strlen(building)), 0) + "
          + " + ".join(f"count({c}) * {w}" for c, w in _WIDTH.items())
          + " AS BIGINT) AS bytes FROM visits_null)", views=("visits_null",))
def q_data_size(spark, sf):
    return rounded(pf.data_size(view(spark, sf, "visits_null")))


# -- A3 / A4 / A6 / A7 / A8 ---------------------------------------------------------
@register("column_totals", _union([
    f"SELECT '{c}' AS \"column\", round(sum({c}::DOUBLE), 4) AS total, round(avg({c}), 4) AS mean, "
    f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(min({c})::DOUBLE, 4) AS min, "
    f"round(max({c})::DOUBLE, 4) AS max FROM visits" for c in NUM_COLS]))
def q_column_totals(spark, sf):
    return rounded(pf.column_totals(view(spark, sf)), 4)


_STATS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def _describe_sql(c, dt=False):
    """Numbers under the plain names, a datetime's statistics (to the second)
    under the _ts names."""
    v = f"epoch({c})" if dt else f"{c}::DOUBLE"
    e = {"mean": f"avg({v})", "std": f"stddev_samp({v})", "min": f"min({v})", "max": f"max({v})"}
    e |= {f"p{p}": f"quantile_cont({v}, 0.{p})" for p in (25, 50, 75)}
    plain = [f"{'NULL::DOUBLE' if dt else f'round({e[s]}, 3)'} AS {s}" for s in _STATS]
    times = [f"{f'make_timestamp(CAST(floor({e[s]}) AS BIGINT) * 1000000)' if dt else 'NULL::TIMESTAMP'} AS {s}_ts"
             for s in _STATS if s != "std"]
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, {', '.join(plain + times)} FROM visits"


@register("describe", _union([_describe_sql("visit_date", True)]
                             + [_describe_sql(c) for c in NUM_COLS]))
def q_describe(spark, sf):
    out = rounded(pf.describe(view(spark, sf)), 3)
    times = [c for c in out.columns if c.endswith("_ts")]
    return out.withColumns({c: F.date_trunc("second", c).cast("timestamp_ntz") for c in times})


_TYPES = {"building": "string", "visit_date": "timestamp_ntz", "attendees": "double",
          "capacity": "double", "l_orderkey": "bigint", "l_linenumber": "int",
          "l_partkey": "bigint", "l_suppkey": "bigint"}


@register("column_profile", _union([
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS values, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS distinct "
    f"FROM visits_null" for c, t in _TYPES.items()]), views=("visits_null",))
def q_column_profile(spark, sf):
    return pf.column_profile(view(spark, sf, "visits_null"))


@register("column_profile_numeric", _union([
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, "
    f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max FROM visits_null"
    for c in NUM_COLS]), views=("visits_null",))
def q_column_profile_numeric(spark, sf):
    return rounded(pf.column_profile_numeric(view(spark, sf, "visits_null")), 4)


@register("top_values", """
SELECT "column", value, count, rank FROM (
  SELECT "column", value, count,
         row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rank
  FROM (SELECT "column", value, count(*) AS count FROM (
          SELECT 'building' AS "column", building AS value FROM visits_null
          UNION ALL SELECT 'visit_date', CAST(visit_date AS VARCHAR) FROM visits_null)
        WHERE value IS NOT NULL GROUP BY "column", value))
WHERE rank <= 5""", views=("visits_null",))
def q_top_values(spark, sf):
    return pf.top_values(view(spark, sf, "visits_null"))


# -- A17 / A18 ---------------------------------------------------------------------
@register("group_values", "SELECT DISTINCT building FROM visits_null WHERE building IS NOT NULL",
          views=("visits_null",))
def q_group_values(spark, sf):
    return pf.group_values(view(spark, sf, "visits_null"), "building")


@register("group_preview", """
SELECT n AS n_groups, first_groups, greatest(n - 5, 0) AS more FROM
  (SELECT count(DISTINCT building) AS n FROM visits_null),
  (SELECT list(building ORDER BY building) AS first_groups FROM
     (SELECT DISTINCT building FROM visits_null WHERE building IS NOT NULL
      ORDER BY building LIMIT 5))""", views=("visits_null",))
def q_group_preview(spark, sf):
    return pf.group_preview(view(spark, sf, "visits_null"), "building")


# -- A9-A16 --------------------------------------------------------------------------
_CMP = {"sum": "coalesce(sum(attendees), 0)", "mean": "avg(attendees)",
        "count": "count(attendees)", "max": "max(attendees)", "min": "min(attendees)"}
for _m, _e in _CMP.items():
    def _mk(m=_m):
        def q(spark, sf):
            return rounded(gr.compare_groups(view(spark, sf, "visits_null"), "building",
                                             "attendees", m))
        return q
    _sql = (f"SELECT building, {'round(' + _e + ', 6)' if _m in ('mean',) else _e} AS value "
            f"FROM visits_null WHERE building IS NOT NULL GROUP BY building")
    register(f"compare_groups_{_m}", _sql, views=("visits_null",))(_mk())


@register("group_totals", """
SELECT building, coalesce(sum(attendees), 0) AS value FROM visits WHERE building IS NOT NULL
GROUP BY building""")
def q_group_totals(spark, sf):
    return rounded(gr.group_totals(view(spark, sf), "building", "attendees"))


@register("group_totals_orders", """
SELECT segment, round(coalesce(sum(total_price), 0), 2) AS value FROM order_values
WHERE segment IS NOT NULL GROUP BY segment""", views=("order_values",))
def q_group_totals_orders(spark, sf):
    return rounded(gr.group_totals(view(spark, sf, "order_values"), "segment", "total_price"), 2)


_GT = """g AS (SELECT building, coalesce(sum(attendees), 0) AS value FROM visits_null
              WHERE building IS NOT NULL GROUP BY building)"""


@register("compare_groups_summary", _GT + """
SELECT round(sum(value), 6) AS total, round(avg(value), 6) AS average, count(*) AS groups,
       arg_min(building, struct_pack(a := -value, b := building)) AS top_group,
       round(max(value), 6) AS top_value FROM g""", views=("visits_null",))
def q_compare_groups_summary(spark, sf):
    g = gr.compare_groups(view(spark, sf, "visits_null"), "building", "attendees", "sum")
    return rounded(gr.compare_groups_summary(g, "building"))


@register("top_groups", _GT + """
SELECT building, value FROM g ORDER BY value DESC, building LIMIT 10""", views=("visits_null",))
def q_top_groups(spark, sf):
    g = gr.compare_groups(view(spark, sf, "visits_null"), "building", "attendees", "sum")
    return rounded(gr.top_groups(g, "building"))


@register("group_multi_agg", """
SELECT building, coalesce(sum(attendees), 0) AS sum, round(avg(attendees), 6) AS mean,
       count(attendees) AS count FROM visits_null WHERE building IS NOT NULL GROUP BY building""",
          views=("visits_null",))
def q_group_multi_agg(spark, sf):
    return rounded(gr.group_multi_agg(view(spark, sf, "visits_null"), "building", "attendees"))


_BW = _GT.replace("value", "sum") + """, bw AS (
SELECT arg_min(building, struct_pack(a := -sum, b := building)) AS best_group,
       max(sum) AS best_value,
       arg_min(building, struct_pack(a := sum, b := building)) AS worst_group,
       min(sum) AS worst_value FROM g)"""


@register("best_worst_group", _BW + """
SELECT best_group, best_value, worst_group, worst_value FROM bw""", views=("visits_null",))
def q_best_worst_group(spark, sf):
    return rounded(gr.best_worst_group(view(spark, sf, "visits_null"), "building", "attendees")
                   .drop("gap_pct"))


@register("performance_gap", _BW + f"""
SELECT best_group, worst_group,
       round({nn("CASE WHEN best_value <> 0 THEN (best_value - worst_value) / best_value * 100 END")}, 6)
       AS gap_pct FROM bw""", views=("visits_null",))
def q_performance_gap(spark, sf):
    return rounded(gr.best_worst_group(view(spark, sf, "visits_null"), "building", "attendees")
                   .select("best_group", "worst_group", "gap_pct"))


@register("group_concentration", _GT + """
SELECT arg_min(building, struct_pack(a := -value, b := building)) AS top_group,
       max(value) AS top_value, sum(value) AS total, round(avg(value), 6) AS mean,
       min(value) AS min, max(value) AS max,
       round(max(value) / sum(value) * 100, 6) AS top_share_pct FROM g""",
          views=("visits_null",))
def q_group_concentration(spark, sf):
    return rounded(gr.group_concentration(view(spark, sf, "visits_null"), "building",
                                          "attendees"))


@register("group_cards", """
SELECT building, coalesce(sum(attendees), 0) AS total_attendees,
       coalesce(sum(capacity), 0) AS total_capacity, round(avg(attendees), 6) AS avg_attendees,
       round(avg(capacity), 6) AS avg_capacity, count(*) AS rows
FROM visits_null WHERE building IS NOT NULL GROUP BY building""", views=("visits_null",))
def q_group_cards(spark, sf):
    return rounded(gr.group_cards(view(spark, sf, "visits_null"), "building", "attendees",
                                  "capacity"))


_STATS = [("total", "coalesce(sum({c}), 0.0)"), ("count", "count({c})::DOUBLE"),
          ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
          ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
          ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]


@register("group_summary", _union([
    f"SELECT building, '{c}' AS \"column\", {j}::BIGINT AS stat_order, '{st}' AS stat, "
    f"round({e.format(c=c)}, 6) AS value FROM visits_null WHERE building IS NOT NULL "
    f"GROUP BY building"
    for c in ("attendees", "capacity") for j, (st, e) in enumerate(_STATS)]),
    views=("visits_null",))
def q_group_summary(spark, sf):
    return rounded(gr.group_summary(view(spark, sf, "visits_null"), "building",
                                    ["attendees", "capacity"]))


# -- A20 / C4 ----------------------------------------------------------------------
@register("correlation_matrix", _union([
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, round({nn(f'corr({a}, {b})')}, 6) AS r, "
    f"round({nn(f'corr({a}, {b})')}, 2) AS r_label FROM visits"
    for a in NUM_COLS for b in NUM_COLS]))
def q_correlation_matrix(spark, sf):
    return rounded(pf.correlation_matrix(view(spark, sf), NUM_COLS))


# -- A19 / C3 ----------------------------------------------------------------------
_MONTHLY = """SELECT building, strftime(visit_date, '%b-%Y') AS month,
       CAST(min(date_trunc('month', visit_date)) AS DATE) AS month_start,
       coalesce(sum(attendees), 0) AS attendees, coalesce(sum(capacity), 0) AS capacity
FROM visits WHERE building IS NOT NULL AND visit_date IS NOT NULL
GROUP BY building, month"""


@register("monthly_summary", _MONTHLY)
def q_monthly_summary(spark, sf):
    return rounded(mo.monthly_summary(view(spark, sf), "building", "visit_date",
                                      ["attendees", "capacity"]))


@register("chart_monthly", f"""m AS ({_MONTHLY})
SELECT building, month, month_start, 'attendees' AS series, attendees AS value FROM m
UNION ALL
SELECT building, month, month_start, 'capacity' AS series, capacity AS value FROM m""")
def q_chart_monthly(spark, sf):
    s = mo.monthly_summary(view(spark, sf), "building", "visit_date", ["attendees", "capacity"])
    return rounded(mo.chart_monthly(s, "building", ["attendees", "capacity"]))


# -- P10-P15, L1, L4 ------------------------------------------------------------------
_SEL = "building, visit_date, attendees, capacity, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@register("filter_group", f"SELECT {_SEL} FROM visits WHERE building = 'Brand#13'")
def q_filter_group(spark, sf):
    return fl.filter_group(view(spark, sf), "building", "Brand#13")


@register("filter_equals", f"SELECT {_SEL} FROM visits WHERE attendees = 5")
def q_filter_equals(spark, sf):
    return fl.filter_data(view(spark, sf), "attendees", "equals", "5")


@register("filter_gt", f"SELECT {_SEL} FROM visits_null WHERE attendees > 45",
          views=("visits_null",))
def q_filter_gt(spark, sf):
    return fl.filter_data(view(spark, sf, "visits_null"), "attendees", ">", "45")


@register("filter_lt", f"SELECT {_SEL} FROM visits WHERE capacity < 3")
def q_filter_lt(spark, sf):
    return fl.filter_data(view(spark, sf), "capacity", "<", "3")


@register("filter_contains", f"""SELECT {_SEL} FROM visits_null
WHERE coalesce(regexp_matches(CAST(building AS VARCHAR), 'brand#1[23]', 'i'), false)""",
          views=("visits_null",))
def q_filter_contains(spark, sf):
    return fl.filter_data(view(spark, sf, "visits_null"), "building", "contains", "brand#1[23]")


@register("filter_summary", """SELECT count(*) FILTER (WHERE
  coalesce(regexp_matches(CAST(building AS VARCHAR), 'brand#1[23]', 'i'), false)) AS matches,
  count(*) AS rows,
  round(count(*) FILTER (WHERE coalesce(regexp_matches(CAST(building AS VARCHAR),
        'brand#1[23]', 'i'), false)) * 100.0 / count(*), 6) AS match_pct
FROM visits_null""", views=("visits_null",))
def q_filter_summary(spark, sf):
    return rounded(fl.filter_summary(view(spark, sf, "visits_null"), "building", "contains",
                                     "brand#1[23]"))


@register("filter_sample", f"""SELECT {_SEL} FROM visits WHERE attendees > 45
ORDER BY {', '.join(KEY)} LIMIT 5""")
def q_filter_sample(spark, sf):
    return fl.filter_sample(view(spark, sf), "attendees", ">", "45", KEY)


@register("head10", f"SELECT {_SEL} FROM visits ORDER BY {', '.join(KEY)} LIMIT 10")
def q_head10(spark, sf):
    return fl.head(view(spark, sf), KEY)


# -- the other aggregate names compare_groups accepts ---------------------------------
_CMP_MORE = {"median": "round(quantile_cont(attendees, 0.5), 6)",
             "std": f"round({nn('stddev_samp(attendees)')}, 6)",
             "var": f"round({nn('var_samp(attendees)')}, 6)",
             "nunique": "count(DISTINCT attendees)"}
for _m, _e in _CMP_MORE.items():
    def _mk2(m=_m):
        def q(spark, sf):
            return rounded(gr.compare_groups(view(spark, sf, "visits_null"), "building",
                                             "attendees", m))
        return q
    register(f"compare_groups_{_m}",
             f"SELECT building, {_e} AS value FROM visits_null WHERE building IS NOT NULL "
             f"GROUP BY building", views=("visits_null",))(_mk2())
