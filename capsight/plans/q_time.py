"""Catalog: utilization (U) and time-series (T) queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsight.operators import timeseries as ts
from capsight.operators import utilization as ut
from capsight.plans.base import nn, register, roles_of, rounded, util_sql, view

R = roles_of("visits")
KEY_ORDER = "visit_date NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey"

# -- shared oracle fragments -------------------------------------------------
# Daily series in the calendar-join form (independent of the Spark plan,
# which expands present days instead of joining a calendar).
DAILY_CTES = f"""r AS (
  SELECT building, CAST(visit_date AS DATE) AS day, attendees, capacity,
         {util_sql()} AS u
  FROM {{src}} WHERE building IS NOT NULL AND visit_date IS NOT NULL
), d AS (
  SELECT building, day, avg(u) AS occupied_pct, avg(attendees) AS attendees,
         avg(capacity) AS capacity, sum(attendees) AS sa, sum(capacity) AS sc,
         count(*) AS rows
  FROM r GROUP BY building, day
), d2 AS (
  SELECT *, CASE WHEN sa IS NULL AND sc IS NULL THEN NULL
                 ELSE {util_sql('coalesce(sa, 0.0)', 'coalesce(sc, 0.0)')} END AS sum_ratio_pct
  FROM d
), cal AS (
  SELECT building,
         CAST(unnest(generate_series(CAST(mn AS TIMESTAMP), CAST(mx AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT building, min(day) AS mn, max(day) AS mx FROM d GROUP BY building)
), f AS (
  SELECT cal.building, cal.day,
         last_value(d2.occupied_pct IGNORE NULLS) OVER w AS occupied_pct,
         last_value(d2.attendees IGNORE NULLS) OVER w AS attendees,
         last_value(d2.capacity IGNORE NULLS) OVER w AS capacity,
         last_value(d2.sum_ratio_pct IGNORE NULLS) OVER w AS sum_ratio_pct,
         coalesce(d2.rows, 0) AS rows, d2.rows IS NULL AS is_filled
  FROM cal LEFT JOIN d2 ON cal.building = d2.building AND cal.day = d2.day
  WINDOW w AS (PARTITION BY cal.building ORDER BY cal.day
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s AS (
  SELECT *, date_diff('day', min(day) OVER (PARTITION BY building), day) AS day_index,
         count(*) OVER (PARTITION BY building) AS n_days
  FROM f
)"""


def daily_ctes(src: str = "visits") -> str:
    return DAILY_CTES.replace("{src}", src)


ROWIDX_CTE = f"""ix AS (
  SELECT *, row_number() OVER (PARTITION BY building ORDER BY {KEY_ORDER}) - 1 AS row_index,
         count(*) OVER (PARTITION BY building) AS group_rows
  FROM visits WHERE building IS NOT NULL
)"""

LONG_CTE = ROWIDX_CTE + """, l AS (
  SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index,
         'attendees' AS metric, coalesce(attendees, 0.0) AS value FROM ix
  UNION ALL
  SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index,
         'capacity' AS metric, coalesce(capacity, 0.0) AS value FROM ix
)"""

TREND_SQL = LONG_CTE + f""", g AS (
  SELECT building, metric, count(*) AS n, regr_slope(value, row_index) AS sl,
         regr_intercept(value, row_index) AS ic, corr(value, row_index) AS r0,
         var_pop(value) AS vy, arg_min(value, row_index) AS first_value,
         arg_max(value, row_index) AS last_value
  FROM l GROUP BY building, metric
), t AS (
  SELECT building, metric, n,
         CASE WHEN n > 1 THEN {nn('sl')} END AS slope,
         CASE WHEN n > 1 THEN {nn('ic')} END AS intercept,
         CASE WHEN n <= 1 THEN NULL WHEN vy = 0 THEN 0.0 ELSE {nn('r0')} END AS r,
         first_value, last_value,
         CASE WHEN n <= 1 THEN NULL WHEN first_value <> 0
              THEN (last_value - first_value) / first_value * 100 ELSE 0.0 END AS change_pct
  FROM g
), t2 AS (
  SELECT *, r * r AS r2,
         CASE WHEN slope IS NULL THEN 'unknown' WHEN slope > 0 THEN 'up'
              WHEN slope < 0 THEN 'down' ELSE 'stable' END AS direction
  FROM t
), t3 AS (
  SELECT *, CASE WHEN n > 1 THEN CASE WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.3
         THEN 'moderate' ELSE 'weak' END END AS strength FROM t2
)"""


# -- U1 ----------------------------------------------------------------------
@register("utilization_rows", f"""
SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, attendees, capacity,
       round({util_sql()}, 6) AS utilization_pct
FROM visits_zero""", views=("visits_zero",))
def q_utilization_rows(spark, sf):
    return rounded(ut.utilization_rows(view(spark, sf, "visits_zero"), R))


# -- U2 / U3 -----------------------------------------------------------------
@register("utilization_stats", f"""
SELECT building, count(*) AS n, round(avg(u), 6) AS mean_pct, round(max(u), 6) AS max_pct,
       round(min(u), 6) AS min_pct, round(stddev_samp(u), 6) AS std_pct
FROM (SELECT building, {util_sql()} AS u FROM visits WHERE building IS NOT NULL)
GROUP BY building""")
def q_utilization_stats(spark, sf):
    return rounded(ut.utilization_stats(view(spark, sf), R)
                   .select("building", "n", "mean_pct", "max_pct", "min_pct", "std_pct"))


@register("utilization_stats_nan", f"""
SELECT building, count(*) AS n, round(avg(u), 6) AS mean_pct, round(max(u), 6) AS max_pct,
       round(min(u), 6) AS min_pct, round(stddev_samp(u), 6) AS std_pct
FROM (SELECT building, {util_sql()} AS u FROM visits_nan WHERE building IS NOT NULL)
GROUP BY building""", views=("visits_nan",))
def q_utilization_stats_nan(spark, sf):
    return rounded(ut.utilization_stats(view(spark, sf, "visits_nan"), R)
                   .select("building", "n", "mean_pct", "max_pct", "min_pct", "std_pct"))


@register("utilization_bands3", f"""
SELECT building, count(*) FILTER (WHERE u < 50) AS low_rows,
       count(*) FILTER (WHERE u >= 50 AND u <= 80) AS optimal_rows,
       count(*) FILTER (WHERE u > 80) AS high_rows
FROM (SELECT building, {util_sql()} AS u FROM visits_zero WHERE building IS NOT NULL)
GROUP BY building""", views=("visits_zero",))
def q_utilization_bands3(spark, sf):
    return ut.utilization_stats(view(spark, sf, "visits_zero"), R) \
             .select("building", "low_rows", "optimal_rows", "high_rows")


@register("utilization_stats_finite", f"""
SELECT building, count(*) AS n, round(avg(u), 6) AS mean_pct, round(max(u), 6) AS max_pct,
       round(min(u), 6) AS min_pct, round(stddev_samp(u), 6) AS std_pct
FROM (SELECT building, CASE WHEN abs({util_sql()}) <> 'inf'::DOUBLE THEN {util_sql()} END AS u
      FROM visits_zero WHERE building IS NOT NULL)
GROUP BY building""", views=("visits_zero",))
def q_utilization_stats_finite(spark, sf):
    return rounded(ut.utilization_stats(view(spark, sf, "visits_zero"), R, finite_only=True)
                   .select("building", "n", "mean_pct", "max_pct", "min_pct", "std_pct"))


# -- U5 ----------------------------------------------------------------------
@register("utilization_class", f"""
SELECT building, cls AS util_class, count(*) AS rows
FROM (SELECT building, CASE WHEN u < 50 THEN 'red' WHEN u < 80 THEN 'orange' ELSE 'green' END AS cls
      FROM (SELECT building, {util_sql()} AS u FROM visits_zero WHERE building IS NOT NULL))
GROUP BY building, cls""", views=("visits_zero",))
def q_utilization_class(spark, sf):
    return (ut.attendance_vs_capacity(view(spark, sf, "visits_zero"), R)
              .groupBy("building", "util_class").agg(F.count(F.lit(1)).alias("rows")))


# -- U8 flagship and its parts (T8-T12, C5) ---------------------------------
FLAGSHIP_SQL = "WITH_DAILY, t AS (" + """
  SELECT *, regr_slope(occupied_pct, day_index) OVER (PARTITION BY building) AS sl,
         regr_intercept(occupied_pct, day_index) OVER (PARTITION BY building) AS ic,
         max(occupied_pct) OVER (PARTITION BY building) AS mx,
         min(occupied_pct) OVER (PARTITION BY building) AS mn
  FROM s
), t2 AS (
  SELECT *, min(CASE WHEN occupied_pct = mx THEN day END) OVER (PARTITION BY building) AS peak,
            min(CASE WHEN occupied_pct = mn THEN day END) OVER (PARTITION BY building) AS low
  FROM t
)
SELECT building, day, round(occupied_pct, 6) AS occupied_pct, round(attendees, 6) AS attendees,
       round(capacity, 6) AS capacity, round(sum_ratio_pct, 6) AS sum_ratio_pct, rows, is_filled,
       day_index, n_days,
       round(CASE WHEN n_days > 1 THEN ic + sl * day_index END, 6) AS trend,
       CASE WHEN occupied_pct < 50 THEN 'critical' WHEN occupied_pct < 80 THEN 'moderate'
            WHEN occupied_pct <= 100 THEN 'optimal' WHEN occupied_pct > 100 THEN 'over' END AS zone,
       occupied_pct > 100 AS over_capacity,
       round(greatest(occupied_pct - 100, 0.0), 6) AS over_excess,
       day = peak AS is_peak, day = low AS is_low
FROM t2"""


def _flagship_sql(src="visits"):
    return FLAGSHIP_SQL.replace("WITH_DAILY", daily_ctes(src))


@register("daily_utilization", _flagship_sql())
def q_daily_utilization(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf), R))


@register("daily_utilization_null", _flagship_sql("visits_null"), views=("visits_null",))
def q_daily_utilization_null(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf, "visits_null"), R))


@register("daily_utilization_nan", _flagship_sql("visits_nan"), views=("visits_nan",))
def q_daily_utilization_nan(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf, "visits_nan"), R))


@register("daily_ffill_long_gap", f"""{daily_ctes("visits_gap")}
SELECT building, count(*) AS days, CAST(sum(CAST(is_filled AS INT)) AS BIGINT) AS filled_days, min(day) AS first_day,
       max(day) AS last_day, round(avg(occupied_pct), 6) AS occupied_pct FROM f GROUP BY building""",
          views=("visits_gap",))
def q_daily_ffill_long_gap(spark, sf):
    """A gap of a century is filled like any other."""
    d = ts.daily_ffill(view(spark, sf, "visits_gap"), R)
    return rounded(d.groupBy("building").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("is_filled").alias("filled_days"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), F.avg("occupied_pct").alias("occupied_pct")))


@register("daily_mean", f"""{daily_ctes()}
SELECT building, day, round(occupied_pct, 6) AS occupied_pct, round(attendees, 6) AS attendees,
       round(capacity, 6) AS capacity, rows FROM d""")
def q_daily_mean(spark, sf):
    return rounded(ts.daily_mean(view(spark, sf), R).drop("_sum_a", "_sum_c"))


@register("daily_mean_usage", f"""{daily_ctes()}
SELECT building, day, round(occupied_pct, 6) AS occupied_pct, round(attendees, 6) AS attendees,
       round(capacity, 6) AS capacity, rows FROM d""".replace("FROM visits", "FROM usage"),
          views=("usage",))
def q_daily_mean_usage(spark, sf):
    return rounded(ts.daily_mean(view(spark, sf, "usage"), roles_of("usage"))
                   .drop("_sum_a", "_sum_c"))


@register("daily_ffill", f"""{daily_ctes()}
SELECT building, day, round(occupied_pct, 6) AS occupied_pct, round(attendees, 6) AS attendees,
       round(capacity, 6) AS capacity, round(sum_ratio_pct, 6) AS sum_ratio_pct, rows, is_filled
FROM f""")
def q_daily_ffill(spark, sf):
    return rounded(ts.daily_ffill(view(spark, sf), R))


@register("daily_trend_line", _flagship_sql().split("\nSELECT building, day,")[0] + """
SELECT building, day, day_index, round(occupied_pct, 6) AS occupied_pct,
       round(CASE WHEN n_days > 1 THEN ic + sl * day_index END, 6) AS trend FROM t2""")
def q_daily_trend_line(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf), R)
                   .select("building", "day", "day_index", "occupied_pct", "trend"))


@register("peak_low_day", f"""{daily_ctes()}
SELECT building, round(max(occupied_pct), 6) AS peak_value,
       arg_min(day, struct_pack(a := -occupied_pct, b := day)) AS peak_day,
       round(min(occupied_pct), 6) AS low_value,
       arg_min(day, struct_pack(a := occupied_pct, b := day)) AS low_day
FROM f GROUP BY building""")
def q_peak_low_day(spark, sf):
    return rounded(ts.peak_low_day(ts.daily_ffill(view(spark, sf), R), R))


@register("daily_caption", f"""{daily_ctes()}
SELECT building, round(avg(occupied_pct), 6) AS average_pct, count(*) AS days,
       round(greatest(max(occupied_pct) + 10, 110.0), 6) AS y_top
FROM f GROUP BY building""")
def q_daily_caption(spark, sf):
    return rounded(ts.daily_caption(ts.daily_ffill(view(spark, sf), R), R))


# -- U4 / U6 / U7 ------------------------------------------------------------
DSTATS_SQL = """, st AS (
  SELECT building, count(*) AS n_days, avg(occupied_pct) AS mean_pct,
         quantile_cont(occupied_pct, 0.5) AS median_pct, max(occupied_pct) AS max_pct,
         min(occupied_pct) AS min_pct, stddev_samp(occupied_pct) AS std_pct,
         regr_slope(occupied_pct, day_index) AS sl, corr(occupied_pct, day_index) AS r0,
         var_pop(occupied_pct) AS vy,
         count(*) FILTER (WHERE occupied_pct < 50) AS critical_days,
         count(*) FILTER (WHERE occupied_pct >= 50 AND occupied_pct < 80) AS moderate_days,
         count(*) FILTER (WHERE occupied_pct >= 80 AND occupied_pct <= 100) AS optimal_days,
         count(*) FILTER (WHERE occupied_pct > 100) AS over_days
  FROM s GROUP BY building
), st2 AS (
  SELECT *, CASE WHEN n_days > 1 THEN coalesce(""" + nn("sl") + """, 0.0) ELSE 0.0 END AS slope_per_day,
         CASE WHEN n_days > 1 AND vy <> 0 THEN coalesce(""" + nn("r0") + """, 0.0) ELSE 0.0 END AS r
  FROM st
)"""


@register("daily_utilization_stats", daily_ctes() + DSTATS_SQL + """
SELECT building, n_days, round(mean_pct, 6) AS mean_pct, round(median_pct, 6) AS median_pct,
       round(max_pct, 6) AS max_pct, round(min_pct, 6) AS min_pct, round(std_pct, 6) AS std_pct
FROM st2""")
def q_daily_utilization_stats(spark, sf):
    d = ut.daily_utilization(view(spark, sf), R)
    return rounded(ut.daily_utilization_stats(d, R).select(
        "building", "n_days", "mean_pct", "median_pct", "max_pct", "min_pct", "std_pct"))


@register("daily_utilization_trend", daily_ctes() + DSTATS_SQL + """
SELECT building, round(slope_per_day, 6) AS slope_per_day, round(r, 6) AS r,
       round(r * r, 6) AS r2,
       CASE WHEN n_days <= 1 THEN 'unknown' WHEN slope_per_day > 0 THEN 'increasing'
            WHEN slope_per_day < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
       CASE WHEN abs(slope_per_day) > 0.1 THEN CASE WHEN abs(r) > 0.7 THEN 'strong'
            WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END END AS strength
FROM st2""")
def q_daily_utilization_trend(spark, sf):
    d = ut.daily_utilization(view(spark, sf), R)
    return rounded(ut.daily_utilization_stats(d, R).select(
        "building", "slope_per_day", "r", "r2", "direction", "strength"))


@register("utilization_bands4", daily_ctes() + DSTATS_SQL + """
SELECT building, critical_days, moderate_days, optimal_days, over_days,
       round(critical_days / n_days * 100, 6) AS critical_pct,
       round(moderate_days / n_days * 100, 6) AS moderate_pct,
       round(optimal_days / n_days * 100, 6) AS optimal_pct,
       round(over_days / n_days * 100, 6) AS over_pct
FROM st2""")
def q_utilization_bands4(spark, sf):
    d = ut.daily_utilization(view(spark, sf), R)
    return rounded(ut.daily_utilization_stats(d, R).select(
        "building", "critical_days", "moderate_days", "optimal_days", "over_days",
        "critical_pct", "moderate_pct", "optimal_pct", "over_pct"))


# -- U9 ----------------------------------------------------------------------
@register("attendance_vs_capacity", f"""
SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, attendees, capacity,
       capacity - attendees AS gap, round(u, 6) AS utilization_pct,
       CASE WHEN u < 50 THEN 'red' WHEN u < 80 THEN 'orange' ELSE 'green' END AS util_class
FROM (SELECT *, {util_sql()} AS u FROM visits WHERE building IS NOT NULL)""")
def q_attendance_vs_capacity(spark, sf):
    return rounded(ut.attendance_vs_capacity(view(spark, sf), R))


# -- T2 ----------------------------------------------------------------------
@register("row_index", f"""WITH_ROWIDX
SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index, group_rows
FROM ix""".replace("WITH_ROWIDX", ROWIDX_CTE))
def q_row_index(spark, sf):
    return rounded(ts.row_index(view(spark, sf), R).select(
        "building", "visit_date", *R.order_key, "row_index", "group_rows"))


# -- T3-T6 -------------------------------------------------------------------
@register("trend_regression", TREND_SQL + """
SELECT building, metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(r, 6) AS r, round(r2, 6) AS r2 FROM t3""")
def q_trend_regression(spark, sf):
    return rounded(ts.trend_regression(view(spark, sf), R)
                   .select("building", "metric", "n", "slope", "intercept", "r", "r2"))


@register("trend_direction", TREND_SQL + """
SELECT building, metric, direction FROM t3""")
def q_trend_direction(spark, sf):
    return ts.trend_regression(view(spark, sf), R).select("building", "metric", "direction")


@register("trend_change", TREND_SQL + """
SELECT building, metric, first_value, last_value, round(change_pct, 6) AS change_pct FROM t3""")
def q_trend_change(spark, sf):
    return rounded(ts.trend_regression(view(spark, sf), R)
                   .select("building", "metric", "first_value", "last_value", "change_pct"))


@register("trend_strength", TREND_SQL + """
SELECT building, metric, round(r2, 6) AS r2, strength FROM t3""")
def q_trend_strength(spark, sf):
    return rounded(ts.trend_regression(view(spark, sf), R)
                   .select("building", "metric", "r2", "strength"))


# -- T7 / T14 ------------------------------------------------------------------
TREND_LINE_SQL = LONG_CTE + """, c AS (
  SELECT building, metric, count(*) AS n, regr_slope(value, row_index) AS sl,
         regr_intercept(value, row_index) AS ic FROM l GROUP BY building, metric
)
SELECT l.building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index,
       l.metric, value, round(CASE WHEN n > 1 THEN ic + sl * row_index END, 6) AS fitted
FROM l JOIN c ON l.building = c.building AND l.metric = c.metric"""


@register("trend_line", TREND_LINE_SQL)
def q_trend_line(spark, sf):
    return rounded(ts.trend_line(view(spark, sf), R))


@register("multi_metric_trend", TREND_LINE_SQL)
def q_multi_metric_trend(spark, sf):
    # metrics missing from the table are skipped, as the chart skips them
    return rounded(ts.trend_line(view(spark, sf), R, ["attendees", "capacity", "headcount"]))


# -- T13 -----------------------------------------------------------------------
@register("recent_vs_earlier", ROWIDX_CTE.replace("SELECT *,", f"SELECT *, {util_sql()} AS u,") + """
SELECT building, count(*) AS n,
       round(avg(u) FILTER (WHERE row_index < 3), 6) AS earlier_mean,
       round(avg(u) FILTER (WHERE row_index >= group_rows - 3), 6) AS recent_mean
FROM ix GROUP BY building""")
def q_recent_vs_earlier(spark, sf):
    return rounded(ts.recent_vs_earlier(view(spark, sf), R))


# -- one hot group: every row in one building (skew) ----------------------------------
def _one(sql: str) -> str:
    return sql.replace("FROM visits WHERE", "FROM visits_one WHERE")


@register("daily_utilization_one_group", _flagship_sql("visits_one"), views=("visits_one",))
def q_daily_utilization_one_group(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf, "visits_one"), R))


@register("trend_regression_one_group", _one(TREND_SQL) + """
SELECT building, metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(r, 6) AS r, round(r2, 6) AS r2 FROM t3""", views=("visits_one",))
def q_trend_regression_one_group(spark, sf):
    return rounded(ts.trend_regression(view(spark, sf, "visits_one"), R)
                   .select("building", "metric", "n", "slope", "intercept", "r", "r2"))


@register("row_index_one_group", _one(f"""WITH_ROWIDX
SELECT building, visit_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index, group_rows
FROM ix""".replace("WITH_ROWIDX", ROWIDX_CTE)), views=("visits_one",))
def q_row_index_one_group(spark, sf):
    return rounded(ts.row_index(view(spark, sf, "visits_one"), R).select(
        "building", "visit_date", *R.order_key, "row_index", "group_rows"))


# -- sub-day events with zero capacities (infinite utilization on some days) ----------
@register("daily_utilization_usage", _flagship_sql("usage"), views=("usage",))
def q_daily_utilization_usage(spark, sf):
    return rounded(ut.daily_utilization(view(spark, sf, "usage"), roles_of("usage")))
