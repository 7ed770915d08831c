"""Capacity utilization (U1-U10): row ratios, bands, the daily series.

The flagship is :func:`daily_utilization` (U8): for every group at once,
the daily occupied percentage with missing days carried forward, its zone,
the fitted trend line, and the peak / low day. Its plan is one partial
aggregate over the rows on (group, day) followed by windows over the daily
series only (one row per group-day), so no step ever holds a whole group's
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from capsight.functions.exprs import (FULL_PCT, LOW_PCT, OPTIMAL_PCT, nan_to_null, safe_corr,
                                      strength_abs_r, util_class, utilization_pct, zone4)
from capsight.functions.missing import missing_aware
from capsight.operators.timeseries import _grouped, daily_ffill, recent_vs_earlier
from capsight.roles import Roles


@missing_aware
def utilization_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Add ``utilization_pct`` (NULL -> 0, 0/0 -> 0, x/0 -> +-inf)."""
    return df.withColumn("utilization_pct", utilization_pct(roles.primary, roles.secondary))


@missing_aware
def utilization_stats(df: DataFrame, roles: Roles, finite_only: bool = False) -> DataFrame:
    """U2 + U3: mean, max, min, sample std of row utilization and the three
    row bands (< 50, 50..80 inclusive, > 80) per group."""
    u = utilization_pct(roles.primary, roles.secondary)
    if finite_only:
        u = F.when(F.abs(u) != F.lit(float("inf")), u)
    return _grouped(df, roles).groupBy(*roles.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(u).alias("mean_pct"),
        F.max(u).alias("max_pct"),
        F.min(u).alias("min_pct"),
        nan_to_null(F.stddev_samp(u)).alias("std_pct"),
        F.count_if(u < LOW_PCT).alias("low_rows"),
        F.count_if((u >= LOW_PCT) & (u <= OPTIMAL_PCT)).alias("optimal_rows"),
        F.count_if(u > OPTIMAL_PCT).alias("high_rows"))


@missing_aware
def utilization_movement(df: DataFrame, roles: Roles) -> DataFrame:
    """T13 on utilization, the input of the growing / declining rule."""
    return recent_vs_earlier(df, roles)


@missing_aware
def daily_utilization(df: DataFrame, roles: Roles) -> DataFrame:
    """U8 (+U10, C5, T8, T11): the full daily utilization dataset.

    Columns: keys, day, occupied_pct (mean of row ratios), both metric means,
    sum_ratio_pct (ratio of the daily sums), rows, is_filled, day_index,
    n_days, trend (fitted line, NULL for a one-day series), zone,
    over_capacity, over_excess (part above 100 %), is_peak, is_low.
    """
    daily = daily_ffill(df, roles)
    g = W.partitionBy(*roles.keys)
    v = F.col("occupied_pct")
    with_idx = daily.withColumn(
        "day_index", F.datediff(F.col("day"), F.min("day").over(g)).cast("long"))
    x = F.col("day_index").cast("double")
    out = with_idx.select(
        "*",
        F.count(F.lit(1)).over(g).alias("n_days"),
        F.regr_slope(v, x).over(g).alias("_slope"),
        F.regr_intercept(v, x).over(g).alias("_icpt"),
        F.min_by(F.col("day"), F.struct(-v, F.col("day"))).over(g).alias("_peak"),
        F.min_by(F.col("day"), F.struct(v, F.col("day"))).over(g).alias("_low"))
    return out.select(
        *roles.keys, "day", "occupied_pct", roles.primary, roles.secondary, "sum_ratio_pct",
        "rows", "is_filled", "day_index", F.col("n_days").cast("long").alias("n_days"),
        F.when(F.col("n_days") > 1, nan_to_null(F.col("_icpt") + F.col("_slope") * x))
         .alias("trend"),
        zone4(v).alias("zone"),
        (v > FULL_PCT).alias("over_capacity"),
        F.greatest(v - FULL_PCT, F.lit(0.0)).alias("over_excess"),
        (F.col("day") == F.col("_peak")).alias("is_peak"),
        (F.col("day") == F.col("_low")).alias("is_low"))


@missing_aware
def daily_utilization_stats(daily: DataFrame, roles: Roles) -> DataFrame:
    """U6 + U7 + U4 over the filled daily series (filled days count).

    Mean, median, max, min, sample std; slope per day and r over the day
    index (slope 0 / r 0 / direction unknown for a one-day series); the
    four zone counts and their share of days.
    """
    v = F.col("occupied_pct")
    x = F.col("day_index").cast("double") if "day_index" in daily.columns else \
        F.datediff("day", F.lit("1970-01-01")).cast("double")
    agg = daily.groupBy(*roles.keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(v).alias("mean_pct"),
        F.percentile(v, 0.5).alias("median_pct"),
        F.max(v).alias("max_pct"),
        F.min(v).alias("min_pct"),
        nan_to_null(F.stddev_samp(v)).alias("std_pct"),
        F.regr_slope(v, x).alias("_slope"),
        safe_corr(v, x).alias("_r"),
        F.var_pop(v).alias("_vy"),
        F.count_if(v < LOW_PCT).alias("critical_days"),
        F.count_if((v >= LOW_PCT) & (v < OPTIMAL_PCT)).alias("moderate_days"),
        F.count_if((v >= OPTIMAL_PCT) & (v <= FULL_PCT)).alias("optimal_days"),
        F.count_if(v > FULL_PCT).alias("over_days"))
    many = F.col("n_days") > 1
    slope = F.when(many, F.coalesce(nan_to_null(F.col("_slope")), F.lit(0.0))).otherwise(0.0)
    r = F.when(many & (F.col("_vy") != 0), F.coalesce(nan_to_null(F.col("_r")), F.lit(0.0))) \
         .otherwise(0.0)
    pct = lambda c: (F.col(c) / F.col("n_days") * 100).alias(c.replace("_days", "_pct"))
    return agg.select(
        *roles.keys, "n_days", "mean_pct", "median_pct", "max_pct", "min_pct", "std_pct",
        slope.alias("slope_per_day"), r.alias("r"), (r * r).alias("r2"),
        F.when(~many, "unknown").when(slope > 0, "increasing").when(slope < 0, "decreasing")
         .otherwise("stable").alias("direction"),
        F.when(F.abs(slope) > 0.1, strength_abs_r(r)).alias("strength"),
        "critical_days", "moderate_days", "optimal_days", "over_days",
        pct("critical_days"), pct("moderate_days"), pct("optimal_days"), pct("over_days"))


@missing_aware
def attendance_vs_capacity(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows with both metrics, their gap, utilization and bar class (< 50
    red, < 80 orange, else green). The rows come unsorted; a chart sorts them
    by date."""
    u = utilization_pct(roles.primary, roles.secondary)
    return _grouped(df, roles).select(
        *roles.keys, roles.date, *roles.order_key, roles.primary, roles.secondary,
        (F.col(roles.secondary) - F.col(roles.primary)).alias("gap"),
        u.alias("utilization_pct"), util_class(u).alias("util_class"))


__all__ = [
    "utilization_rows", "utilization_stats", "utilization_movement", "daily_utilization",
    "daily_utilization_stats", "attendance_vs_capacity",
]
