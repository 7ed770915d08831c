"""Rule-driven insights and suggestions.

A rule is one row of a table: an id, its family, kind (insight or
suggestion), severity, a condition and a value (both SQL expressions over a
one-row-per-group statistics frame) and a message template. A family is
evaluated for *all* groups in one projection: every rule becomes
``when(condition, struct(...))`` inside one array, NULLs are filtered out
and the array is inlined. No per-group loop, no UDF.

"elif" chains of the original thresholds are spelled out in the conditions,
so every rule can be read and tested on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.functions.missing import missing_aware


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    kind: str          # insight | suggestion
    severity: str      # info | positive | warning | critical
    when: str          # SQL boolean over the stats columns
    value: str         # SQL numeric expression reported with the finding
    template: str      # java.util.Formatter pattern
    args: tuple[str, ...] = ()   # SQL expressions feeding the template


def _r(rule_id, family, kind, severity, when, value, template, *args):
    return Rule(rule_id, family, kind, severity, when, value, template, tuple(args))


ALWAYS = "true"

# ---------------------------------------------------------------------------
# Thresholds and message texts of the findings.

DISTRIBUTION = [  # R1 over distribution_stats + outliers_zscore
    _r("dist_mean_median", "distribution", "insight", "info", ALWAYS, "mean",
       "Mean: %.2f | Median: %.2f", "mean", "median"),
    _r("dist_spread", "distribution", "insight", "info", ALWAYS, "std",
       "Std Dev: %.2f | Range: %.2f", "std", "range"),
    _r("dist_right_skewed", "distribution", "insight", "warning", "skewness > 1", "skewness",
       "Right-skewed (Skewness: %.2f) - Most values on left", "skewness"),
    _r("dist_left_skewed", "distribution", "insight", "warning", "skewness < -1", "skewness",
       "Left-skewed (Skewness: %.2f) - Most values on right", "skewness"),
    _r("dist_symmetric", "distribution", "insight", "positive",
       "NOT coalesce(skewness > 1 OR skewness < -1, false)", "skewness",
       "Symmetric distribution (Skewness: %.2f)", "skewness"),
    _r("dist_outliers", "distribution", "insight", "warning", "outliers_3sigma > 0",
       "outliers_3sigma", "%d outliers detected (>3σ from mean)", "outliers_3sigma"),
]

BOXPLOT = [  # R2 over outliers_iqr
    _r("box_quartiles", "boxplot", "insight", "info", ALWAYS, "iqr",
       "Q1: %.2f | Q3: %.2f | IQR: %.2f", "q1", "q3", "iqr"),
    _r("box_outliers", "boxplot", "insight", "info", ALWAYS, "outlier_pct",
       "Outliers: %d (%.1f%%)", "outliers", "outlier_pct"),
    _r("box_high_outliers", "boxplot", "insight", "warning", "outliers > n * 0.1", "outliers",
       "High outlier count - investigate these values"),
    _r("box_normal_outliers", "boxplot", "insight", "positive", "NOT (outliers > n * 0.1)",
       "outliers", "Outlier count is normal"),
]

COMPARISON = [  # R3 over group_concentration (one row for the table)
    _r("cmp_top", "comparison", "insight", "info", ALWAYS, "top_value", "Top: %s (%.2f)",
       "top_group", "top_value"),
    _r("cmp_share", "comparison", "insight", "info", ALWAYS, "top_share_pct",
       "Share: %.1f%% of total", "top_share_pct"),
    _r("cmp_average", "comparison", "insight", "info", ALWAYS, "mean", "Average: %.2f", "mean"),
    _r("cmp_min_max", "comparison", "insight", "info", ALWAYS, "max", "Min: %.2f | Max: %.2f",
       "min", "max"),
]

COMPARISON_SUGGESTIONS = [  # R4 over best_worst_group
    _r("cmp_best", "comparison", "suggestion", "positive", ALWAYS, "best_value",
       "Best performer: %s (%.0f total)", "best_group", "best_value"),
    _r("cmp_worst", "comparison", "suggestion", "warning", ALWAYS, "worst_value",
       "Needs improvement: %s (%.0f total)", "worst_group", "worst_value"),
    _r("cmp_large_gap", "comparison", "suggestion", "warning", "gap_pct > 30", "gap_pct",
       "Large performance gap (%.1f%%) - Review operations at underperforming locations",
       "gap_pct"),
    _r("cmp_share_practices", "comparison", "suggestion", "info", "gap_pct > 30", "gap_pct",
       "Action: Share best practices from top performers with struggling locations"),
]

TREND = [  # R5 over trend_regression, one stats row per (group, metric)
    _r("trend_direction", "trend", "insight", "info", "n > 1", "change_pct",
       "%s trend for %s (Change: %+.1f%%)",
       "CASE direction WHEN 'up' THEN 'Increasing' WHEN 'down' THEN 'Decreasing' "
       "ELSE 'Stable' END", "metric", "change_pct"),
    _r("trend_strong", "trend", "insight", "positive", "n > 1 AND r2 > 0.7", "r2",
       "Strong %s trend (R²: %.2f)", "CASE direction WHEN 'up' THEN 'upward' WHEN 'down' "
       "THEN 'downward' ELSE 'stable' END", "r2"),
    _r("trend_moderate", "trend", "insight", "info", "n > 1 AND r2 <= 0.7 AND r2 > 0.3", "r2",
       "Moderate %s trend (R²: %.2f)", "CASE direction WHEN 'up' THEN 'upward' WHEN 'down' "
       "THEN 'downward' ELSE 'stable' END", "r2"),
    _r("trend_weak", "trend", "insight", "warning", "n > 1 AND NOT coalesce(r2 > 0.3, false)",
       "r2", "Weak trend (R²: %.2f) - highly variable", "r2"),
]

UTILIZATION = [  # R6-R9 over utilization_stats + recent_vs_earlier
    _r("util_average", "utilization", "insight", "info", ALWAYS, "mean_pct",
       "Average Utilization: %.1f%%", "mean_pct"),
    _r("util_peak", "utilization", "insight", "info", ALWAYS, "max_pct",
       "Peak Utilization: %.1f%%", "max_pct"),
    _r("util_lowest", "utilization", "insight", "info", ALWAYS, "min_pct",
       "Lowest Utilization: %.1f%%", "min_pct"),
    _r("util_low_rows", "utilization", "insight", "info", ALWAYS, "low_rows",
       "Low utilization days (<50%%): %d", "low_rows"),
    _r("util_optimal_rows", "utilization", "insight", "info", ALWAYS, "optimal_rows",
       "Optimal utilization days (50-80%%): %d", "optimal_rows"),
    _r("util_high_rows", "utilization", "insight", "info", ALWAYS, "high_rows",
       "High utilization days (>80%%): %d", "high_rows"),
    _r("util_low.1", "utilization", "suggestion", "warning", "mean_pct < 50", "mean_pct",
       "Low average utilization - Consider reducing capacity or increasing promotion efforts"),
    _r("util_low.2", "utilization", "suggestion", "info", "mean_pct < 50", "mean_pct",
       "Suggestion: Run targeted campaigns to boost attendance"),
    _r("util_low.3", "utilization", "suggestion", "info", "mean_pct < 50", "mean_pct",
       "Action: Analyze booking patterns to identify slow periods"),
    _r("util_high.1", "utilization", "suggestion", "critical", "mean_pct >= 50 AND mean_pct > 85",
       "mean_pct", "High utilization - Risk of overcrowding and poor experience"),
    _r("util_high.2", "utilization", "suggestion", "info", "mean_pct >= 50 AND mean_pct > 85",
       "mean_pct", "Suggestion: Increase capacity or implement time-slot management"),
    _r("util_high.3", "utilization", "suggestion", "info", "mean_pct >= 50 AND mean_pct > 85",
       "mean_pct", "Action: Consider expansion or multiple sessions"),
    _r("util_healthy.1", "utilization", "suggestion", "positive",
       "NOT coalesce(mean_pct < 50 OR mean_pct > 85, false)", "mean_pct",
       "Healthy utilization rate - Good balance between capacity and demand"),
    _r("util_healthy.2", "utilization", "suggestion", "info",
       "NOT coalesce(mean_pct < 50 OR mean_pct > 85, false)", "mean_pct",
       "Suggestion: Maintain current operations and monitor trends"),
    _r("util_growing", "utilization", "suggestion", "info",
       "n > 1 AND recent_mean > earlier_mean * 1.2", "recent_mean",
       "Growing demand detected - Plan for capacity expansion"),
    _r("util_declining", "utilization", "suggestion", "warning",
       "n > 1 AND NOT coalesce(recent_mean > earlier_mean * 1.2, false) "
       "AND recent_mean < earlier_mean * 0.8", "recent_mean",
       "Declining attendance - Review scheduling and marketing strategies"),
    _r("util_variability", "utilization", "suggestion", "info", "std_pct > 25", "std_pct",
       "High variability in utilization - Consider dynamic pricing or flexible scheduling"),
]

_LV = "mean_pct"
DAILY = [  # R10-R17 over daily_utilization_stats
    _r("daily_average", "daily", "insight", "info", ALWAYS, "mean_pct",
       "Average Daily Occupied: %.1f%%", "mean_pct"),
    _r("daily_median", "daily", "insight", "info", ALWAYS, "median_pct",
       "Median Occupied: %.1f%%", "median_pct"),
    _r("daily_peak", "daily", "insight", "info", ALWAYS, "max_pct", "Peak Day: %.1f%%", "max_pct"),
    _r("daily_lowest", "daily", "insight", "info", ALWAYS, "min_pct", "Lowest Day: %.1f%%",
       "min_pct"),
    _r("daily_variability", "daily", "insight", "info", ALWAYS, "std_pct",
       "Daily Variability: ±%.1f%%", "std_pct"),
    _r("daily_trend", "daily", "insight", "info", "abs(slope_per_day) > 0.1", "slope_per_day",
       "Daily Trend: %s by %.2f%% per day", "initcap(direction)", "abs(slope_per_day)"),
    _r("daily_trend_strength", "daily", "insight", "info", "abs(slope_per_day) > 0.1", "r2",
       "Trend Strength: %s (R²=%.2f)", "initcap(strength)", "r2"),
    _r("daily_trend_stable", "daily", "insight", "info", "NOT (abs(slope_per_day) > 0.1)",
       "slope_per_day", "Daily Trend: Stable (±%.2f%% per day)", "abs(slope_per_day)"),
    _r("daily_critical_days", "daily", "insight", "info", ALWAYS, "critical_pct",
       "Critical Days (<50%%): %d (%.1f%%)", "critical_days", "critical_pct"),
    _r("daily_moderate_days", "daily", "insight", "info", ALWAYS, "moderate_pct",
       "Moderate Days (50-80%%): %d (%.1f%%)", "moderate_days", "moderate_pct"),
    _r("daily_optimal_days", "daily", "insight", "info", ALWAYS, "optimal_pct",
       "Optimal Days (80-100%%): %d (%.1f%%)", "optimal_days", "optimal_pct"),
    _r("daily_over_days", "daily", "insight", "warning", "over_days > 0", "over_pct",
       "Over-Capacity Days (>100%%): %d (%.1f%%)", "over_days", "over_pct"),
    # R13 level, in order: < 40, < 60, > 95, > 85, else
    _r("daily_level_very_low.1", "daily", "suggestion", "critical", f"{_LV} < 40", _LV,
       "CRITICAL: Very Low Utilization - Immediate action required"),
    _r("daily_level_very_low.2", "daily", "suggestion", "info", f"{_LV} < 40", _LV,
       "Reduce capacity by at least 30%% or launch aggressive marketing campaign"),
    _r("daily_level_very_low.3", "daily", "suggestion", "info", f"{_LV} < 40", _LV,
       "Analyze: Review pricing strategy, service quality, and competitor activity"),
    _r("daily_level_low.1", "daily", "suggestion", "warning", f"{_LV} >= 40 AND {_LV} < 60", _LV,
       "Low Utilization - Below sustainable levels"),
    _r("daily_level_low.2", "daily", "suggestion", "info", f"{_LV} >= 40 AND {_LV} < 60", _LV,
       "Increase marketing efforts and consider promotional pricing"),
    _r("daily_level_low.3", "daily", "suggestion", "info", f"{_LV} >= 40 AND {_LV} < 60", _LV,
       "Review: Operating hours, location accessibility, and customer feedback"),
    _r("daily_level_over.1", "daily", "suggestion", "critical", f"{_LV} >= 60 AND {_LV} > 95", _LV,
       "CRITICAL: Consistent Over-Capacity - Service quality at risk"),
    _r("daily_level_over.2", "daily", "suggestion", "info", f"{_LV} >= 60 AND {_LV} > 95", _LV,
       "Urgent: Expand capacity or implement strict booking limits"),
    _r("daily_level_over.3", "daily", "suggestion", "info", f"{_LV} >= 60 AND {_LV} > 95", _LV,
       "Consider: Multiple sessions, larger venue, or waitlist system"),
    _r("daily_level_high.1", "daily", "suggestion", "warning",
       f"{_LV} >= 60 AND {_LV} <= 95 AND {_LV} > 85", _LV,
       "High Utilization - Operating near maximum capacity"),
    _r("daily_level_high.2", "daily", "suggestion", "info",
       f"{_LV} >= 60 AND {_LV} <= 95 AND {_LV} > 85", _LV,
       "Plan for expansion within next 3-6 months"),
    _r("daily_level_high.3", "daily", "suggestion", "info",
       f"{_LV} >= 60 AND {_LV} <= 95 AND {_LV} > 85", _LV,
       "Monitor: Customer complaints and service quality metrics"),
    _r("daily_level_healthy.1", "daily", "suggestion", "positive",
       f"NOT coalesce({_LV} < 60 OR {_LV} > 85, false)", _LV,
       "Healthy Utilization Range - Good balance achieved"),
    _r("daily_level_healthy.2", "daily", "suggestion", "info",
       f"NOT coalesce({_LV} < 60 OR {_LV} > 85, false)", _LV,
       "Maintain current operations and continue monitoring trends"),
    # R14 trend
    _r("daily_growth_strong.1", "daily", "suggestion", "positive",
       "direction = 'increasing' AND slope_per_day > 0.5", "slope_per_day",
       "Strong Growth Trend - Demand increasing rapidly"),
    _r("daily_growth_strong.2", "daily", "suggestion", "info",
       "direction = 'increasing' AND slope_per_day > 0.5", "slope_per_day",
       "Prepare for capacity expansion - growth will continue"),
    _r("daily_growth_steady.1", "daily", "suggestion", "positive",
       "direction = 'increasing' AND slope_per_day <= 0.5 AND slope_per_day > 0.2",
       "slope_per_day", "Steady Growth - Positive demand trend"),
    _r("daily_growth_steady.2", "daily", "suggestion", "info",
       "direction = 'increasing' AND slope_per_day <= 0.5 AND slope_per_day > 0.2",
       "slope_per_day", "Monitor closely and plan capacity adjustments"),
    _r("daily_decline_concerning.1", "daily", "suggestion", "critical",
       "direction = 'decreasing' AND slope_per_day < -0.5", "slope_per_day",
       "Concerning Decline - Losing customers rapidly"),
    _r("daily_decline_concerning.2", "daily", "suggestion", "info",
       "direction = 'decreasing' AND slope_per_day < -0.5", "slope_per_day",
       "Urgent investigation needed - identify root causes immediately"),
    _r("daily_decline_gradual.1", "daily", "suggestion", "warning",
       "direction = 'decreasing' AND slope_per_day >= -0.5 AND slope_per_day < -0.2",
       "slope_per_day", "Gradual Decline - Demand trending downward"),
    _r("daily_decline_gradual.2", "daily", "suggestion", "info",
       "direction = 'decreasing' AND slope_per_day >= -0.5 AND slope_per_day < -0.2",
       "slope_per_day", "Review retention strategies and gather customer feedback"),
    # R15 variability
    _r("daily_variability_very_high.1", "daily", "suggestion", "warning", "std_pct > 30",
       "std_pct", "Very High Variability - Unpredictable occupancy patterns"),
    _r("daily_variability_very_high.2", "daily", "suggestion", "info", "std_pct > 30",
       "std_pct", "Implement dynamic pricing and flexible scheduling"),
    _r("daily_variability_very_high.3", "daily", "suggestion", "info", "std_pct > 30",
       "std_pct", "Analyze: Day-of-week and seasonal patterns for optimization"),
    _r("daily_variability_moderate.1", "daily", "suggestion", "info",
       "std_pct <= 30 AND std_pct > 20", "std_pct",
       "Moderate Variability - Some inconsistency in occupancy"),
    _r("daily_variability_moderate.2", "daily", "suggestion", "info",
       "std_pct <= 30 AND std_pct > 20", "std_pct",
       "Smooth demand through promotions on low-occupancy days"),
    # R16 over-capacity share
    _r("daily_over_urgent.1", "daily", "suggestion", "critical",
       "over_days > 0 AND over_pct > 20", "over_pct",
       "URGENT: Over-capacity %.0f%% of days - Major safety concern", "over_pct"),
    _r("daily_over_urgent.2", "daily", "suggestion", "info", "over_days > 0 AND over_pct > 20",
       "over_pct", "Immediate action: Increase capacity or reduce daily bookings by 20%%"),
    _r("daily_over_frequent.1", "daily", "suggestion", "warning",
       "over_days > 0 AND over_pct <= 20 AND over_pct > 10", "over_pct",
       "Frequent over-capacity (%.0f%% of days) - Needs attention", "over_pct"),
    _r("daily_over_frequent.2", "daily", "suggestion", "info",
       "over_days > 0 AND over_pct <= 20 AND over_pct > 10", "over_pct",
       "Action: Implement booking caps and consider expansion"),
    # R17 critical days
    _r("daily_too_many_low.1", "daily", "suggestion", "warning",
       "critical_days > n_days * 0.3", "critical_days",
       "Too many low-occupancy days (%d days)", "critical_days"),
    _r("daily_too_many_low.2", "daily", "suggestion", "info", "critical_days > n_days * 0.3",
       "critical_days", "Strategy: Reduce operating days or increase marketing on slow days"),
]

FAMILIES = {
    "distribution": DISTRIBUTION, "boxplot": BOXPLOT, "comparison": COMPARISON,
    "comparison_suggestions": COMPARISON_SUGGESTIONS, "trend": TREND,
    "utilization": UTILIZATION, "daily": DAILY,
}
# ---------------------------------------------------------------------------


def _sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _message_sql(rule: Rule) -> str:
    if not rule.args:
        return _sql_str(rule.template.replace("%%", "%"))
    # halves go to the even digit, as the reference's formatting does; the
    # formatter itself rounds them up
    marks = re.findall(r"%[-+0-9]*(?:\.(\d+)f|[ds])", rule.template.replace("%%", ""))
    args = [f"if(bround({a}, {d}) = 0, {a}, bround({a}, {d}))" if d else a
            for a, d in zip(rule.args, marks, strict=True)]  # zero keeps its sign
    return f"format_string({_sql_str(rule.template)}, {', '.join(args)})"


def fired_rules_sql(rules: list[Rule]) -> str:
    """One SQL expression: the array of fired-rule structs, NULLs removed."""
    items = [
        f"CASE WHEN coalesce({r.when}, false) THEN named_struct("
        f"'rule_id', {_sql_str(r.rule_id)}, 'family', {_sql_str(r.family)}, "
        f"'kind', {_sql_str(r.kind)}, 'severity', {_sql_str(r.severity)}, "
        f"'value', CAST({r.value} AS DOUBLE), 'message', {_message_sql(r)}) END"
        for r in rules]
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"


def evaluate(stats: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """Fire ``rules`` on a stats frame (one row per key): output one row per
    (key, fired rule): keys, rule_id, family, kind, severity, value, message.

    The whole rule table becomes one SQL expression (parsed once) evaluated
    in a single projection over the stats rows."""
    return (stats.select(*keys, F.expr(fired_rules_sql(rules)).alias("_fired"))
                 .select(*keys, F.inline("_fired")))


# ---------------------------------------------------------------------------
# Family entry points: statistics frame + rules, for all groups at once.

def _stats_distribution(df, group, value):
    from capsight.operators.distribution import distribution_stats, outliers_zscore
    z = outliers_zscore(df, group, value).select(group, "outliers_3sigma")
    return distribution_stats(df, group, value).join(z, group)


@missing_aware
def insights_distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distribution facts per group."""
    return evaluate(_stats_distribution(df, group, value), DISTRIBUTION, [group])


@missing_aware
def insights_boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """R2: box-plot facts per group."""
    from capsight.operators.distribution import outliers_iqr
    return evaluate(outliers_iqr(df, group, value), BOXPLOT, [group])


@missing_aware
def insights_comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """R3 + R4: findings across the groups (one set for the table)."""
    from capsight.operators.groups import best_worst_group, group_concentration
    a = evaluate(group_concentration(df, group, value), COMPARISON, [])
    b = evaluate(best_worst_group(df, group, value), COMPARISON_SUGGESTIONS, [])
    return a.unionByName(b)


@missing_aware
def insights_trend(df: DataFrame, roles) -> DataFrame:
    """Direction and strength per group and metric."""
    from capsight.operators.timeseries import trend_regression
    return evaluate(trend_regression(df, roles), TREND, [*roles.keys, "metric"])


def _stats_utilization(df, roles):
    from capsight.operators.timeseries import recent_vs_earlier
    from capsight.operators.utilization import utilization_stats
    mv = recent_vs_earlier(df, roles).select(*roles.keys, "earlier_mean", "recent_mean")
    return utilization_stats(df, roles).join(mv, roles.keys)


@missing_aware
def insights_utilization(df: DataFrame, roles) -> DataFrame:
    """Row utilization facts and suggestions per group."""
    return evaluate(_stats_utilization(df, roles), UTILIZATION, roles.keys)


@missing_aware
def insights_daily(df: DataFrame, roles, daily: DataFrame | None = None) -> DataFrame:
    """Daily occupied-percentage facts and suggestions per group.
    Pass ``daily`` (the output of ``daily_utilization``) to reuse it."""
    from capsight.operators.utilization import daily_utilization, daily_utilization_stats
    d = daily if daily is not None else daily_utilization(df, roles)
    return evaluate(daily_utilization_stats(d, roles), DAILY, roles.keys)


def _row_statistics(df: DataFrame, roles) -> DataFrame:
    """Everything the distribution, box, comparison and utilization rules need
    of a group's rows: one aggregate of the rows, one quantile plan, and one
    pass that counts outliers against both."""
    from capsight.functions.exprs import (LOW_PCT, OPTIMAL_PCT, bias_corrected_skew, nan_to_null,
                                          utilization_pct)
    from capsight.functions.joins import join_small, materialize
    from capsight.operators.quantiles import stats_with_quantiles
    g = roles.group
    rows = df.where(F.col(g).isNotNull()).select(
        g, F.col(roles.primary).cast("double").alias("x"),
        utilization_pct(roles.primary, roles.secondary).alias("u"))
    x, u = F.col("x"), F.col("u")
    base = [
        F.count(x).alias("n"), F.avg(x).alias("mean"), nan_to_null(F.stddev_samp(x)).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("_g1"), F.sum(x).alias("total"),
        F.count(F.lit(1)).alias("rows"), F.avg(u).alias("mean_pct"), F.max(u).alias("max_pct"),
        F.min(u).alias("min_pct"), nan_to_null(F.stddev_samp(u)).alias("std_pct"),
        F.count_if(u < LOW_PCT).alias("low_rows"),
        F.count_if((u >= LOW_PCT) & (u <= OPTIMAL_PCT)).alias("optimal_rows"),
        F.count_if(u > OPTIMAL_PCT).alias("high_rows")]
    skew = nan_to_null(bias_corrected_skew(F.col("_g1"), F.col("n").cast("double"), F.col("std")))
    st = stats_with_quantiles(rows, [g], "x", base, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    st = materialize(st.withColumn("skewness", skew).drop("_g1")
                     .withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1")}))
    bounds = st.select(g, "mean", "std", (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"),
                       (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    far = (F.col("std") > 0) & (F.abs(x - F.col("mean")) > 3 * F.col("std"))
    counts = join_small(rows, bounds, g, materialized=True).groupBy(g).agg(
        F.count_if(F.coalesce(far, F.lit(False))).alias("outliers_3sigma"),
        F.count_if(F.coalesce((x < F.col("_lo")) | (x > F.col("_hi")), F.lit(False))).alias("outliers"))
    return materialize(st.join(counts, g).withColumn(
        "outlier_pct", F.try_divide(F.col("outliers"), F.col("n")) * 100))


@missing_aware
def insights_all(df: DataFrame, roles, daily: DataFrame | None = None,
                 staged: bool = True) -> DataFrame:
    """Every family in one long table: (group, metric, rule_id, family, kind,
    severity, value, message). Findings about the whole table have a NULL
    group.

    The input is read once: the columns the families need are written to the
    shared checkpoint folder (:func:`capsight.functions.joins.stage`), and
    all row statistics are shared between the families. ``staged=False``
    when the input is such a narrow table already."""
    from capsight.functions.joins import reuse_materialized, stage
    from capsight.operators.groups import best_worst_group, group_concentration
    from capsight.operators.timeseries import recent_vs_earlier
    g, p = roles.group, roles.primary
    gtype = df.schema[g].dataType
    if staged:
        cols = [c for c in dict.fromkeys([g, roles.date, roles.primary, roles.secondary,
                                          *roles.order_key]) if c]
        df = stage(df, cols, "insights")

    def shape(x, metric):
        m = F.col("metric") if metric is None else F.lit(metric)
        grp = F.col(g) if g in x.columns else F.lit(None).cast(gtype)
        return x.select(grp.alias(g), m.alias("metric"), "rule_id", "family", "kind",
                        "severity", "value", "message")

    with reuse_materialized():
        stats = _row_statistics(df, roles)
        some = stats.where("n > 0")
        totals = stats.select(g, F.col("total").alias(p))
        moves = recent_vs_earlier(df, roles).select(g, "earlier_mean", "recent_mean")
        util = stats.drop("n").withColumnRenamed("rows", "n").join(moves, g)
        parts = [shape(evaluate(some, DISTRIBUTION, [g]), p), shape(evaluate(some, BOXPLOT, [g]), p),
                 shape(evaluate(group_concentration(totals, g, p), COMPARISON, []), p),
                 shape(evaluate(best_worst_group(totals, g, p), COMPARISON_SUGGESTIONS, []), p),
                 shape(insights_trend(df, roles), None),
                 shape(evaluate(util, UTILIZATION, [g]), "utilization_pct"),
                 shape(insights_daily(df, roles, daily), "occupied_pct")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
