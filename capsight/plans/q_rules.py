"""Catalog: rule-driven insights (R1-R17). The oracle states the rules on its
own, as the if / elif chains of DuckDB SQL over SQL statistics, with their
thresholds and message texts."""

from __future__ import annotations

from capsight.operators import rules as ru
from capsight.plans import q_dist, q_groups, q_time
from capsight.plans.base import nn, register, rounded, roles_of, util_sql, view

R = roles_of("visits_null")
G, P = "building", "attendees"
SRC = "visits_null"

DIST_CHAIN = q_dist.VALS + f""", s AS (
  SELECT building, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
         stddev_samp(x) AS std, min(x) AS min, max(x) AS max, skewness(x) AS sk
  FROM v GROUP BY building
), s2 AS (
  SELECT *, max - min AS range,
         CASE WHEN n < 3 THEN NULL WHEN std = 0 THEN 0.0 ELSE {nn('sk')} END AS skewness FROM s
), z AS (
  SELECT v.building,
         count(*) FILTER (WHERE s2.std > 0 AND abs(x - s2.mean) > 3 * s2.std) AS outliers_3sigma
  FROM v JOIN s2 ON v.building = s2.building GROUP BY v.building
), stats AS (SELECT s2.*, z.outliers_3sigma FROM s2 JOIN z ON s2.building = z.building)"""

BOX_CHAIN = q_dist._IQR + """, stats AS (
  SELECT f.building, n, q1, q3, iqr, outliers, outliers / n * 100 AS outlier_pct
  FROM f JOIN c ON f.building = c.building)"""

CMP_CHAIN = q_groups._GT + """, stats AS (
  SELECT arg_min(building, struct_pack(a := -value, b := building)) AS top_group,
         max(value) AS top_value, sum(value) AS total, avg(value) AS mean, min(value) AS min,
         max(value) AS max, max(value) / sum(value) * 100 AS top_share_pct FROM g)"""

CMPS_CHAIN = q_groups._BW + """, stats AS (
  SELECT *, CASE WHEN best_value <> 0 THEN (best_value - worst_value) / best_value * 100 END
         AS gap_pct FROM bw)"""

TREND_CHAIN = q_time.TREND_SQL.replace("FROM visits WHERE building IS NOT NULL",
                                       f"FROM {SRC} WHERE building IS NOT NULL") \
    + ", stats AS (SELECT * FROM t3)"

UTIL_CHAIN = f"""u AS (SELECT building, {util_sql()} AS u FROM {SRC} WHERE building IS NOT NULL),
us AS (
  SELECT building, count(*) AS n, avg(u) AS mean_pct, max(u) AS max_pct, min(u) AS min_pct,
         {nn('stddev_samp(u)')} AS std_pct,
         count(*) FILTER (WHERE u < 50) AS low_rows,
         count(*) FILTER (WHERE u >= 50 AND u <= 80) AS optimal_rows,
         count(*) FILTER (WHERE u > 80) AS high_rows
  FROM u GROUP BY building
), {q_time.ROWIDX_CTE.replace("SELECT *,", f"SELECT *, {util_sql()} AS u,")
                      .replace("FROM visits WHERE", f"FROM {SRC} WHERE")},
re AS (
  SELECT building, avg(u) FILTER (WHERE row_index < 3) AS earlier_mean,
         avg(u) FILTER (WHERE row_index >= group_rows - 3) AS recent_mean
  FROM ix GROUP BY building
), stats AS (SELECT us.*, re.earlier_mean, re.recent_mean FROM us JOIN re
             ON us.building = re.building)"""

DAILY_CHAIN = q_time.daily_ctes(SRC) + q_time.DSTATS_SQL + """, stats AS (
  SELECT *, r * r AS r2,
         CASE WHEN n_days <= 1 THEN 'unknown' WHEN slope_per_day > 0 THEN 'increasing'
              WHEN slope_per_day < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
         CASE WHEN abs(slope_per_day) > 0.1 THEN CASE WHEN abs(r) > 0.7 THEN 'strong'
              WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END END AS strength,
         critical_days / n_days * 100 AS critical_pct, moderate_days / n_days * 100 AS moderate_pct,
         optimal_days / n_days * 100 AS optimal_pct, over_days / n_days * 100 AS over_pct
  FROM st2)"""


def _f(rule_id, kind, severity, value, message, *args):
    """One finding as a DuckDB struct; ``args`` fill the message's %-marks."""
    text = message.replace("'", "''")
    msg = f"printf('{text}', {', '.join(args)})" if args else f"'{text}'"
    return (f"{{'rule_id': '{rule_id}', 'kind': '{kind}', 'severity': '{severity}', "
            f"'value': CAST({value} AS DOUBLE), 'message': {msg}}}")


def _i(rule_id, value, message, *args, severity="info"):
    return _f(rule_id, "insight", severity, value, message, *args)


def _s(rule_id, severity, value, *messages, args=()):
    """Suggestions that come together: the first with the severity, the
    others as notes."""
    one = len(messages) == 1 and "." not in rule_id
    return ", ".join(_f(rule_id if one else f"{rule_id}.{k + 1}", "suggestion", severity if k == 0 else "info", value, m,
                        *(args if k == 0 else ())) for k, m in enumerate(messages))


def _chain(*branches):
    """CASE of (condition, findings), the first that holds; the last may have
    the condition None (else)."""
    out = "CASE"
    for cond, found in branches:
        out += f" WHEN coalesce({cond}, false) THEN [{found}]" if cond else f" ELSE [{found}]"
    return out + " END"


# ---------------------------------------------------------------------------
# Thresholds and message texts of the findings.
_DIST = [
    "[" + _i("dist_mean_median", "mean", "Mean: %.2f | Median: %.2f", "mean", "median") + "]",
    "[" + _i("dist_spread", "std", "Std Dev: %.2f | Range: %.2f", "std", "range") + "]",
    _chain(("skewness > 1", _i("dist_right_skewed", "skewness",
                               "Right-skewed (Skewness: %.2f) - Most values on left", "skewness", severity="warning")),
           ("skewness < -1", _i("dist_left_skewed", "skewness",
                                "Left-skewed (Skewness: %.2f) - Most values on right", "skewness", severity="warning")),
           (None, _i("dist_symmetric", "skewness", "Symmetric distribution (Skewness: %.2f)", "skewness",
                     severity="positive"))),
    _chain(("outliers_3sigma > 0", _i("dist_outliers", "outliers_3sigma", "%d outliers detected (>3σ from mean)",
                                      "outliers_3sigma", severity="warning"))),
]
_BOX = [
    "[" + _i("box_quartiles", "iqr", "Q1: %.2f | Q3: %.2f | IQR: %.2f", "q1", "q3", "iqr") + "]",
    "[" + _i("box_outliers", "outlier_pct", "Outliers: %d (%.1f%%)", "outliers", "outlier_pct") + "]",
    _chain(("outliers > n * 0.1", _i("box_high_outliers", "outliers", "High outlier count - investigate these values",
                                     severity="warning")),
           (None, _i("box_normal_outliers", "outliers", "Outlier count is normal", severity="positive"))),
]
_CMP = [
    "[" + _i("cmp_top", "top_value", "Top: %s (%.2f)", "top_group", "top_value") + "]",
    "[" + _i("cmp_share", "top_share_pct", "Share: %.1f%% of total", "top_share_pct") + "]",
    "[" + _i("cmp_average", "mean", "Average: %.2f", "mean") + "]",
    "[" + _i("cmp_min_max", "max", "Min: %.2f | Max: %.2f", "min", "max") + "]",
]
_CMPS = [
    "[" + _s("cmp_best", "positive", "best_value", "Best performer: %s (%.0f total)",
             args=("best_group", "best_value")) + "]",
    "[" + _s("cmp_worst", "warning", "worst_value", "Needs improvement: %s (%.0f total)",
             args=("worst_group", "worst_value")) + "]",
    _chain(("gap_pct > 30", _s("cmp_large_gap", "warning", "gap_pct",
                               "Large performance gap (%.1f%%) - Review operations at underperforming locations",
                               args=("gap_pct",)) + ", "
            + _s("cmp_share_practices", "info", "gap_pct",
                 "Action: Share best practices from top performers with struggling locations"))),
]
_UPWARD = "CASE direction WHEN 'up' THEN 'upward' WHEN 'down' THEN 'downward' ELSE 'stable' END"
_RISE = "CASE direction WHEN 'up' THEN 'Increasing' WHEN 'down' THEN 'Decreasing' ELSE 'Stable' END"
_TREND = [
    _chain(("n > 1", _i("trend_direction", "change_pct", "%s trend for %s (Change: %+.1f%%)", _RISE, "metric", "change_pct"))),
    _chain(("n <= 1", ""),
           ("r2 > 0.7", _i("trend_strong", "r2", "Strong %s trend (R²: %.2f)", _UPWARD, "r2", severity="positive")),
           ("r2 > 0.3", _i("trend_moderate", "r2", "Moderate %s trend (R²: %.2f)", _UPWARD, "r2")),
           (None, _i("trend_weak", "r2", "Weak trend (R²: %.2f) - highly variable", "r2", severity="warning"))),
]
_UTIL = [
    "[" + ", ".join([
        _i("util_average", "mean_pct", "Average Utilization: %.1f%%", "mean_pct"),
        _i("util_peak", "max_pct", "Peak Utilization: %.1f%%", "max_pct"),
        _i("util_lowest", "min_pct", "Lowest Utilization: %.1f%%", "min_pct"),
        _i("util_low_rows", "low_rows", "Low utilization days (<50%%): %d", "low_rows"),
        _i("util_optimal_rows", "optimal_rows", "Optimal utilization days (50-80%%): %d", "optimal_rows"),
        _i("util_high_rows", "high_rows", "High utilization days (>80%%): %d", "high_rows")]) + "]",
    _chain(("mean_pct < 50", _s("util_low", "warning", "mean_pct",
                                "Low average utilization - Consider reducing capacity or increasing promotion efforts",
                                "Suggestion: Run targeted campaigns to boost attendance",
                                "Action: Analyze booking patterns to identify slow periods")),
           ("mean_pct > 85", _s("util_high", "critical", "mean_pct",
                                "High utilization - Risk of overcrowding and poor experience",
                                "Suggestion: Increase capacity or implement time-slot management",
                                "Action: Consider expansion or multiple sessions")),
           (None, _s("util_healthy", "positive", "mean_pct",
                     "Healthy utilization rate - Good balance between capacity and demand",
                     "Suggestion: Maintain current operations and monitor trends"))),
    _chain(("n <= 1", ""),
           ("recent_mean > earlier_mean * 1.2", _s("util_growing", "info", "recent_mean",
                                                   "Growing demand detected - Plan for capacity expansion")),
           ("recent_mean < earlier_mean * 0.8", _s("util_declining", "warning", "recent_mean",
                                                   "Declining attendance - Review scheduling and marketing strategies"))),
    _chain(("std_pct > 25", _s("util_variability", "info", "std_pct",
                               "High variability in utilization - Consider dynamic pricing or flexible scheduling"))),
]
_TITLE = "upper({0}[1]) || {0}[2:]"
_DAILY = [
    "[" + ", ".join([
        _i("daily_average", "mean_pct", "Average Daily Occupied: %.1f%%", "mean_pct"),
        _i("daily_median", "median_pct", "Median Occupied: %.1f%%", "median_pct"),
        _i("daily_peak", "max_pct", "Peak Day: %.1f%%", "max_pct"),
        _i("daily_lowest", "min_pct", "Lowest Day: %.1f%%", "min_pct"),
        _i("daily_variability", "std_pct", "Daily Variability: ±%.1f%%", "std_pct"),
        _i("daily_critical_days", "critical_pct", "Critical Days (<50%%): %d (%.1f%%)", "critical_days", "critical_pct"),
        _i("daily_moderate_days", "moderate_pct", "Moderate Days (50-80%%): %d (%.1f%%)", "moderate_days", "moderate_pct"),
        _i("daily_optimal_days", "optimal_pct", "Optimal Days (80-100%%): %d (%.1f%%)", "optimal_days", "optimal_pct")])
    + "]",
    _chain(("abs(slope_per_day) > 0.1",
            _i("daily_trend", "slope_per_day", "Daily Trend: %s by %.2f%% per day", _TITLE.format("direction"),
               "abs(slope_per_day)") + ", "
            + _i("daily_trend_strength", "r2", "Trend Strength: %s (R²=%.2f)", _TITLE.format("strength"), "r2")),
           (None, _i("daily_trend_stable", "slope_per_day", "Daily Trend: Stable (±%.2f%% per day)", "abs(slope_per_day)"))),
    _chain(("over_days > 0", _i("daily_over_days", "over_pct", "Over-Capacity Days (>100%%): %d (%.1f%%)", "over_days",
                                "over_pct", severity="warning"))),
    _chain(("mean_pct < 40", _s("daily_level_very_low", "critical", "mean_pct",
                                "CRITICAL: Very Low Utilization - Immediate action required",
                                "Reduce capacity by at least 30% or launch aggressive marketing campaign",
                                "Analyze: Review pricing strategy, service quality, and competitor activity")),
           ("mean_pct < 60", _s("daily_level_low", "warning", "mean_pct", "Low Utilization - Below sustainable levels",
                                "Increase marketing efforts and consider promotional pricing",
                                "Review: Operating hours, location accessibility, and customer feedback")),
           ("mean_pct > 95", _s("daily_level_over", "critical", "mean_pct",
                                "CRITICAL: Consistent Over-Capacity - Service quality at risk",
                                "Urgent: Expand capacity or implement strict booking limits",
                                "Consider: Multiple sessions, larger venue, or waitlist system")),
           ("mean_pct > 85", _s("daily_level_high", "warning", "mean_pct",
                                "High Utilization - Operating near maximum capacity",
                                "Plan for expansion within next 3-6 months",
                                "Monitor: Customer complaints and service quality metrics")),
           (None, _s("daily_level_healthy", "positive", "mean_pct", "Healthy Utilization Range - Good balance achieved",
                     "Maintain current operations and continue monitoring trends"))),
    _chain(("direction = 'increasing' AND slope_per_day > 0.5",
            _s("daily_growth_strong", "positive", "slope_per_day", "Strong Growth Trend - Demand increasing rapidly",
               "Prepare for capacity expansion - growth will continue")),
           ("direction = 'increasing' AND slope_per_day > 0.2",
            _s("daily_growth_steady", "positive", "slope_per_day", "Steady Growth - Positive demand trend",
               "Monitor closely and plan capacity adjustments")),
           ("direction = 'decreasing' AND slope_per_day < -0.5",
            _s("daily_decline_concerning", "critical", "slope_per_day", "Concerning Decline - Losing customers rapidly",
               "Urgent investigation needed - identify root causes immediately")),
           ("direction = 'decreasing' AND slope_per_day < -0.2",
            _s("daily_decline_gradual", "warning", "slope_per_day", "Gradual Decline - Demand trending downward",
               "Review retention strategies and gather customer feedback"))),
    _chain(("std_pct > 30", _s("daily_variability_very_high", "warning", "std_pct",
                               "Very High Variability - Unpredictable occupancy patterns",
                               "Implement dynamic pricing and flexible scheduling",
                               "Analyze: Day-of-week and seasonal patterns for optimization")),
           ("std_pct > 20", _s("daily_variability_moderate", "info", "std_pct",
                               "Moderate Variability - Some inconsistency in occupancy",
                               "Smooth demand through promotions on low-occupancy days"))),
    _chain(("over_days > 0 AND over_pct > 20",
            _s("daily_over_urgent", "critical", "over_pct", "URGENT: Over-capacity %.0f%% of days - Major safety concern",
               "Immediate action: Increase capacity or reduce daily bookings by 20%", args=("over_pct",))),
           ("over_days > 0 AND over_pct > 10",
            _s("daily_over_frequent", "warning", "over_pct", "Frequent over-capacity (%.0f%% of days) - Needs attention",
               "Action: Implement booking caps and consider expansion", args=("over_pct",)))),
    _chain(("critical_days > n_days * 0.3",
            _s("daily_too_many_low", "warning", "critical_days", "Too many low-occupancy days (%d days)",
               "Strategy: Reduce operating days or increase marketing on slow days", args=("critical_days",)))),
]
# ---------------------------------------------------------------------------


def _family_sql(chain, family, findings, keys):
    k = ", ".join(keys) + ", " if keys else ""
    every = ", ".join(f"coalesce({x}, [])" for x in findings)
    return (f"{chain}\nSELECT {k}e.rule_id AS rule_id, '{family}' AS family, e.kind AS kind, e.severity AS severity, "
            f"round(e.value, 6) AS value, e.message AS message "
            f"FROM (SELECT {k}unnest(flatten([{every}])) AS e FROM stats)")


@register("insights_distribution", _family_sql(DIST_CHAIN, "distribution", _DIST, [G]), views=(SRC,))
def q_insights_distribution(spark, sf):
    return rounded(ru.insights_distribution(view(spark, sf, SRC), G, P))


@register("insights_boxplot", _family_sql(BOX_CHAIN, "boxplot", _BOX, [G]), views=(SRC,))
def q_insights_boxplot(spark, sf):
    return rounded(ru.insights_boxplot(view(spark, sf, SRC), G, P))


@register("insights_comparison",
          f"SELECT * FROM (WITH {_family_sql(CMP_CHAIN, "comparison", _CMP, [])})\nUNION ALL\n"
          f"SELECT * FROM (WITH {_family_sql(CMPS_CHAIN, "comparison", _CMPS, [])})",
          views=(SRC,))
def q_insights_comparison(spark, sf):
    return rounded(ru.insights_comparison(view(spark, sf, SRC), G, P))


@register("insights_trend", _family_sql(TREND_CHAIN, "trend", _TREND, [G, "metric"]), views=(SRC,))
def q_insights_trend(spark, sf):
    return rounded(ru.insights_trend(view(spark, sf, SRC), R))


@register("insights_utilization", _family_sql(UTIL_CHAIN, "utilization", _UTIL, [G]), views=(SRC,))
def q_insights_utilization(spark, sf):
    return rounded(ru.insights_utilization(view(spark, sf, SRC), R))


@register("insights_daily", _family_sql(DAILY_CHAIN, "daily", _DAILY, [G]), views=(SRC,))
def q_insights_daily(spark, sf):
    return rounded(ru.insights_daily(view(spark, sf, SRC), R))


def _sub(chain, family, findings, keys, metric):
    k = "building" if G in keys else "NULL::VARCHAR AS building"
    m = "metric" if "metric" in keys else f"'{metric}' AS metric"
    return (f"SELECT {k}, {m}, rule_id, family, kind, severity, value, message FROM "
            f"(WITH {_family_sql(chain, family, findings, keys)})")


_ALL_SQL = "\nUNION ALL\n".join([
    _sub(DIST_CHAIN, "distribution", _DIST, [G], P),
    _sub(BOX_CHAIN, "boxplot", _BOX, [G], P),
    _sub(CMP_CHAIN, "comparison", _CMP, [], P),
    _sub(CMPS_CHAIN, "comparison", _CMPS, [], P),
    _sub(TREND_CHAIN, "trend", _TREND, [G, "metric"], None),
    _sub(UTIL_CHAIN, "utilization", _UTIL, [G], "utilization_pct"),
    _sub(DAILY_CHAIN, "daily", _DAILY, [G], "occupied_pct")])


@register("insights_all", _ALL_SQL, views=(SRC,))
def q_insights_all(spark, sf):
    return rounded(ru.insights_all(view(spark, sf, SRC), R))


# -- every rule family when one building holds all rows (skew) --------------------------
@register("insights_all_one_group", _ALL_SQL.replace("visits_null", "visits_one"),
          views=("visits_one",))
def q_insights_all_one_group(spark, sf):
    return rounded(ru.insights_all(view(spark, sf, "visits_one"), R))
