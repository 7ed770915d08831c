"""Catalog: distribution and outlier statistics (D1-D10), chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsight.operators import distribution as ds
from capsight.operators import groups as gr
from capsight.plans.base import nn, register, rounded, view

G, V = "building", "attendees"
VALS = """v AS (SELECT building, attendees AS x FROM visits_null
       WHERE building IS NOT NULL AND attendees IS NOT NULL)"""
QUART = VALS + """, q AS (
  SELECT building, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
         quantile_cont(x, 0.75) AS q3 FROM v GROUP BY building
), f AS (
  SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
  FROM q
)"""


def _df(spark, sf):
    return view(spark, sf, "visits_null")


_DIST_SQL = VALS + f""", s AS (
  SELECT building, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
         stddev_samp(x) AS std, min(x) AS min, max(x) AS max, skewness(x) AS sk
  FROM v GROUP BY building
), s2 AS (
  SELECT *, CASE WHEN n < 3 THEN NULL WHEN std = 0 THEN 0.0 ELSE {nn('sk')} END AS skewness FROM s
)
SELECT building, n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       min, max, max - min AS range, round(skewness, 6) AS skewness,
       CASE WHEN skewness > 1 THEN 'right' WHEN skewness < -1 THEN 'left' ELSE 'symmetric' END
       AS skew_class
FROM s2"""


@register("distribution_stats", _DIST_SQL, views=("visits_null",))
def q_distribution_stats(spark, sf):
    return rounded(ds.distribution_stats(_df(spark, sf), G, V))


@register("distribution_stats_nan", _DIST_SQL.replace("visits_null", "visits_nan"), views=("visits_nan",))
def q_distribution_stats_nan(spark, sf):
    return rounded(ds.distribution_stats(view(spark, sf, "visits_nan"), G, V))


@register("skew_class", VALS + f""", s AS (
  SELECT building, count(*) AS n, stddev_samp(x) AS std, skewness(x) AS sk FROM v GROUP BY building
), s2 AS (
  SELECT building, CASE WHEN n < 3 THEN NULL WHEN std = 0 THEN 0.0 ELSE {nn('sk')} END AS skewness
  FROM s
)
SELECT building, CASE WHEN skewness > 1 THEN 'right' WHEN skewness < -1 THEN 'left'
       ELSE 'symmetric' END AS skew_class FROM s2""", views=("visits_null",))
def q_skew_class(spark, sf):
    return ds.distribution_stats(_df(spark, sf), G, V).select(G, "skew_class")


@register("outliers_zscore", QUART + """
SELECT v.building, count(*) AS n,
       count(*) FILTER (WHERE std > 0 AND abs(x - mean) > 3 * std) AS outliers_3sigma
FROM v JOIN f ON v.building = f.building GROUP BY v.building""", views=("visits_null",))
def q_outliers_zscore(spark, sf):
    return ds.outliers_zscore(_df(spark, sf), G, V)


_IQR = QUART + """, c AS (
  SELECT v.building, count(*) FILTER (WHERE x < lower_fence OR x > upper_fence) AS outliers
  FROM v JOIN f ON v.building = f.building GROUP BY v.building
)"""


@register("outliers_iqr", _IQR + """
SELECT f.building, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, outliers,
       round(outliers / n * 100, 6) AS outlier_pct, outliers > n * 0.1 AS high_outliers
FROM f JOIN c ON f.building = c.building""", views=("visits_null",))
def q_outliers_iqr(spark, sf):
    return rounded(ds.outliers_iqr(_df(spark, sf), G, V))


@register("outlier_flag", _IQR + """
SELECT f.building, outliers > n * 0.1 AS high_outliers FROM f JOIN c ON f.building = c.building""",
          views=("visits_null",))
def q_outlier_flag(spark, sf):
    return ds.outliers_iqr(_df(spark, sf), G, V).select(G, "high_outliers")


@register("outlier_rows", QUART.replace(
    "v AS (SELECT building, attendees AS x FROM visits_null",
    "v AS (SELECT building, attendees * attendees * attendees * attendees AS x, l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey FROM visits_null") + """
SELECT v.building, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN x < lower_fence THEN 'low' ELSE 'high' END AS side,
       coalesce(std > 0 AND abs(x - mean) > 3 * std, false) AS beyond_3sigma
FROM v JOIN f ON v.building = f.building WHERE x < lower_fence OR x > upper_fence""",
          views=("visits_null",))
def q_outlier_rows(spark, sf):
    """Over the fourth power of the head count, which has a long tail."""
    a = F.col("attendees")
    return ds.outlier_rows(_df(spark, sf).withColumn("attendees", a * a * a * a), G, V,
                           ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("boxplot_stats", QUART + """, w AS (
  SELECT v.building, min(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence) AS whisker_low,
         max(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence) AS whisker_high,
         count(*) FILTER (WHERE NOT (x >= lower_fence AND x <= upper_fence)) AS fliers
  FROM v JOIN f ON v.building = f.building GROUP BY v.building
)
SELECT f.building, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr, whisker_low, whisker_high, fliers
FROM f JOIN w ON f.building = w.building""", views=("visits_null",))
def q_boxplot_stats(spark, sf):
    return rounded(ds.boxplot_stats(_df(spark, sf), G, V))


_HIST = VALS + """, mm AS (
  SELECT building, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM v GROUP BY building
), b0 AS (
  SELECT v.building, x, lo, hi, (hi - lo) / 30 AS step,
         least(29, CAST(floor((x - lo) * (30.0 / (hi - lo))) AS BIGINT)) AS b0
  FROM v JOIN mm ON v.building = mm.building
), b1 AS (
  SELECT *, CASE WHEN x < lo + b0 * step THEN b0 - 1 ELSE b0 END AS b1 FROM b0
), b2 AS (
  SELECT building, CASE WHEN x >= lo + (b1 + 1) * step AND b1 <> 29 THEN b1 + 1 ELSE b1 END AS bin
  FROM b1
), cnt AS (SELECT building, bin, count(*) AS count FROM b2 GROUP BY building, bin),
grid AS (SELECT building, lo, hi, CAST(unnest(range(0, 30)) AS BIGINT) AS bin FROM mm)"""


@register("histogram", _HIST + """
SELECT grid.building, grid.bin, round(lo + grid.bin * ((hi - lo) / 30), 6) AS bin_lo,
       round(CASE WHEN grid.bin = 29 THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / 30) END, 6)
       AS bin_hi, coalesce(count, 0) AS count
FROM grid LEFT JOIN cnt ON grid.building = cnt.building AND grid.bin = cnt.bin""",
          views=("visits_null",))
def q_histogram(spark, sf):
    return rounded(ds.histogram(_df(spark, sf), G, V))


_KDE = VALS + """, vc AS (SELECT building, x, count(*) AS cnt FROM v GROUP BY building, x),
st AS (
  SELECT building, n, std * pow(n::DOUBLE, -0.2) AS h, mn - 0.5 * (mx - mn) AS lo,
         mx + 0.5 * (mx - mn) AS hi
  FROM (SELECT building, count(*) AS n, stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx
        FROM v GROUP BY building)
), st2 AS (SELECT *, (hi - lo) / 999 AS step FROM st WHERE n >= 2 AND h > 0),
grid AS (SELECT building, n, h, lo, step, unnest(range(0, 1000)) AS k FROM st2),
dens AS (
  SELECT grid.building, k, any_value(lo) AS lo, any_value(step) AS step,
         sum(cnt * exp(-0.5 * ((lo + k * step - x) / h) * ((lo + k * step - x) / h)))
           / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM grid JOIN vc ON grid.building = vc.building GROUP BY grid.building, k
)"""


@register("kde", _KDE + """
SELECT building, CAST(k AS BIGINT) AS point, round(lo + k * step, 6) AS x,
       round(density, 9) AS density FROM dens""", views=("visits_null",))
def q_kde(spark, sf):
    out = ds.kde(_df(spark, sf), G, V)
    return out.select(G, "point", F.round("x", 6).alias("x"),
                      F.round("density", 9).alias("density"))


def _hist_layer():
    return _HIST + """, h AS (
  SELECT grid.building, lo + grid.bin * ((hi - lo) / 30) AS bin_lo,
         CASE WHEN grid.bin = 29 THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / 30) END AS bin_hi,
         coalesce(count, 0) AS count
  FROM grid LEFT JOIN cnt ON grid.building = cnt.building AND grid.bin = cnt.bin)
SELECT building, 'histogram' AS layer, round((bin_lo + bin_hi) / 2, 6) AS x,
       round(CAST(count AS DOUBLE), 6) AS y FROM h"""


def _kde_layer():
    return _KDE + """
SELECT building, 'density' AS layer, round(lo + k * step, 6) AS x, round(density, 6) AS y
FROM dens"""


_MARKERS = VALS + """, s AS (SELECT building, avg(x) AS mean, quantile_cont(x, 0.5) AS median
              FROM v GROUP BY building)
SELECT building, 'mean' AS layer, round(mean, 6) AS x, NULL::DOUBLE AS y FROM s
UNION ALL SELECT building, 'median' AS layer, round(median, 6) AS x, NULL::DOUBLE AS y FROM s"""


@register("chart_distribution", f"""SELECT * FROM (WITH {_hist_layer()})
UNION ALL SELECT * FROM (WITH {_kde_layer()})
UNION ALL SELECT * FROM (WITH {_MARKERS})""", views=("visits_null",))
def q_chart_distribution(spark, sf):
    return rounded(ds.chart_distribution(_df(spark, sf), G, V))


@register("chart_bar", """
SELECT building, coalesce(sum(attendees), 0) AS value,
       round_even(coalesce(sum(attendees), 0), 0) AS label
FROM visits WHERE building IS NOT NULL GROUP BY building""")
def q_chart_bar(spark, sf):
    g = gr.group_totals(view(spark, sf), G, V)
    return rounded(g.withColumn("label", F.bround("value", 0)))


# -- a skewed money metric: order totals by market segment ------------------------------
_OV = """v AS (SELECT segment, total_price AS x, order_key FROM order_values
       WHERE segment IS NOT NULL AND total_price IS NOT NULL), q AS (
  SELECT segment, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
         quantile_cont(x, 0.75) AS q3 FROM v GROUP BY segment
), f AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q
)"""


@register("outlier_rows_usage", _OV.replace("segment", "building").replace(
    "total_price", "attendees").replace("order_key", "event_id").replace("order_values", "usage")
    + """
SELECT v.building, event_id, CASE WHEN x < lower_fence THEN 'low' ELSE 'high' END AS side,
       coalesce(std > 0 AND abs(x - mean) > 3 * std, false) AS beyond_3sigma
FROM v JOIN f ON v.building = f.building WHERE x < lower_fence OR x > upper_fence""",
          views=("usage",))
def q_outlier_rows_usage(spark, sf):
    # event values are heavy-tailed: this key has real outliers at every scale
    return ds.outlier_rows(view(spark, sf, "usage"), "building", "attendees", ["event_id"])


@register("distribution_stats_orders", f"""{_OV}, s AS (
  SELECT segment, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
         stddev_samp(x) AS std, min(x) AS min, max(x) AS max, skewness(x) AS sk
  FROM v GROUP BY segment
), s2 AS (
  SELECT *, CASE WHEN n < 3 THEN NULL WHEN std = 0 THEN 0.0 ELSE {nn('sk')} END AS skewness FROM s
)
SELECT segment, n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
       round(min, 4) AS min, round(max, 4) AS max, round(max - min, 4) AS range,
       round(skewness, 6) AS skewness,
       CASE WHEN skewness > 1 THEN 'right' WHEN skewness < -1 THEN 'left' ELSE 'symmetric' END
       AS skew_class
FROM s2""", views=("order_values",))
def q_distribution_stats_orders(spark, sf):
    d = ds.distribution_stats(view(spark, sf, "order_values"), "segment", "total_price")
    four = ["mean", "median", "std", "min", "max", "range"]
    return d.select("segment", "n", *[F.round(c, 4).alias(c) for c in four],
                    F.round("skewness", 6).alias("skewness"), "skew_class")
