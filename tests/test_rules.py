"""Every rule fires at its threshold and stays silent just below it."""

from capsight.operators import rules as ru


def fired(spark, rules, rows, schema):
    df = spark.createDataFrame(rows, schema)
    out = ru.evaluate(df, rules, ["id"]).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, set()).add(r.rule_id)
    return got


DAILY_SCHEMA = ("id INT, n_days BIGINT, mean_pct DOUBLE, median_pct DOUBLE, max_pct DOUBLE, "
                "min_pct DOUBLE, std_pct DOUBLE, slope_per_day DOUBLE, r DOUBLE, r2 DOUBLE, "
                "direction STRING, strength STRING, critical_days BIGINT, moderate_days BIGINT, "
                "optimal_days BIGINT, over_days BIGINT, critical_pct DOUBLE, moderate_pct DOUBLE, "
                "optimal_pct DOUBLE, over_pct DOUBLE")


def daily_row(i, mean=70.0, std=10.0, slope=0.0, over=0, crit=0, n=10):
    d = "increasing" if slope > 0 else "decreasing" if slope < 0 else "stable"
    return (i, n, mean, mean, mean + 5, mean - 5, std, slope, 0.5, 0.25, d, "moderate",
            crit, n - crit - over, 0, over, crit / n * 100, (n - crit - over) / n * 100, 0.0,
            over / n * 100)


def level(ids):
    return {x.split(".")[0] for x in ids if x.startswith("daily_level")}


def test_daily_level_chain(spark):
    means = [39.9, 40.0, 59.9, 60.0, 85.0, 85.1, 95.0, 95.1]
    got = fired(spark, ru.DAILY, [daily_row(i, m) for i, m in enumerate(means)], DAILY_SCHEMA)
    assert [level(got[i]) for i in range(len(means))] == [
        {"daily_level_very_low"}, {"daily_level_low"}, {"daily_level_low"},
        {"daily_level_healthy"}, {"daily_level_healthy"}, {"daily_level_high"},
        {"daily_level_high"}, {"daily_level_over"}]


def test_daily_trend_variability_over_and_critical(spark):
    rows = [daily_row(0, slope=0.6), daily_row(1, slope=0.5), daily_row(2, slope=0.2),
            daily_row(3, slope=-0.6), daily_row(4, slope=-0.3), daily_row(5, slope=0.1),
            daily_row(6, std=30.1), daily_row(7, std=30.0), daily_row(8, std=20.0),
            daily_row(9, over=3), daily_row(10, over=2), daily_row(11, over=1),
            daily_row(12, crit=4), daily_row(13, crit=3)]
    g = fired(spark, ru.DAILY, rows, DAILY_SCHEMA)
    assert "daily_growth_strong.1" in g[0] and "daily_growth_steady.1" in g[1]
    assert not any(x.startswith("daily_growth") for x in g[2])
    assert "daily_decline_concerning.1" in g[3] and "daily_decline_gradual.1" in g[4]
    assert "daily_trend_stable" in g[5] and "daily_trend" not in g[5]
    assert "daily_trend" in g[0] and "daily_trend_strength" in g[0]
    assert "daily_variability_very_high.1" in g[6]
    assert "daily_variability_moderate.1" in g[7]
    assert not any(x.startswith("daily_variability_") for x in g[8])
    assert "daily_over_urgent.1" in g[9] and "daily_over_frequent.1" in g[10]
    assert "daily_over_days" in g[11] and not any("over_" in x and "." in x for x in g[11])
    assert "daily_over_days" not in g[0]
    assert "daily_too_many_low.1" in g[12] and "daily_too_many_low.1" not in g[13]


UTIL_SCHEMA = ("id INT, n BIGINT, mean_pct DOUBLE, max_pct DOUBLE, min_pct DOUBLE, "
               "std_pct DOUBLE, low_rows BIGINT, optimal_rows BIGINT, high_rows BIGINT, "
               "earlier_mean DOUBLE, recent_mean DOUBLE")


def test_utilization_rules(spark):
    rows = [(0, 5, 49.9, 90.0, 1.0, 25.1, 1, 1, 1, 50.0, 60.1),
            (1, 5, 50.0, 90.0, 1.0, 25.0, 1, 1, 1, 50.0, 60.0),
            (2, 5, 85.1, 90.0, 1.0, 5.0, 1, 1, 1, 50.0, 39.9),
            (3, 1, 70.0, 90.0, 1.0, None, 1, 1, 1, 50.0, 99.0)]
    g = fired(spark, ru.UTILIZATION, rows, UTIL_SCHEMA)
    assert "util_low.1" in g[0] and "util_growing" in g[0] and "util_variability" in g[0]
    assert "util_healthy.1" in g[1] and "util_growing" not in g[1]
    assert "util_variability" not in g[1]
    assert "util_high.1" in g[2] and "util_declining" in g[2]
    assert "util_growing" not in g[3]            # needs more than one row


def test_distribution_box_trend_comparison_rules(spark):
    d = fired(spark, ru.DISTRIBUTION,
              [(0, 1.0, 1.0, 1.0, 2.0, 1.01, 0), (1, 1.0, 1.0, 1.0, 2.0, -1.0, 2),
               (2, 1.0, 1.0, 1.0, 2.0, None, 0)],
              "id INT, mean DOUBLE, median DOUBLE, std DOUBLE, range DOUBLE, skewness DOUBLE, "
              "outliers_3sigma BIGINT")
    assert "dist_right_skewed" in d[0] and "dist_outliers" not in d[0]
    assert "dist_symmetric" in d[1] and "dist_outliers" in d[1]
    assert "dist_symmetric" in d[2]
    b = fired(spark, ru.BOXPLOT, [(0, 100, 1.0, 2.0, 1.0, 11, 11.0), (1, 100, 1.0, 2.0, 1.0, 10, 10.0)],
              "id INT, n BIGINT, q1 DOUBLE, q3 DOUBLE, iqr DOUBLE, outliers BIGINT, "
              "outlier_pct DOUBLE")
    assert "box_high_outliers" in b[0] and "box_normal_outliers" in b[1]
    t = fired(spark, ru.TREND, [(0, 5, "a", "up", 0.71, 10.0), (1, 5, "a", "down", 0.7, 1.0),
                                (2, 5, "a", "stable", 0.3, 0.0), (3, 1, "a", "unknown", None, None)],
              "id INT, n BIGINT, metric STRING, direction STRING, r2 DOUBLE, change_pct DOUBLE")
    assert "trend_strong" in t[0] and "trend_moderate" in t[1] and "trend_weak" in t[2]
    assert 3 not in t
    c = fired(spark, ru.COMPARISON_SUGGESTIONS,
              [(0, "a", 10.0, "b", 6.9, 31.0), (1, "a", 10.0, "b", 7.0, 30.0)],
              "id INT, best_group STRING, best_value DOUBLE, worst_group STRING, "
              "worst_value DOUBLE, gap_pct DOUBLE")
    assert "cmp_large_gap" in c[0] and "cmp_large_gap" not in c[1]


def test_messages_are_formatted(spark):
    df = spark.createDataFrame([daily_row(0, 39.94)], DAILY_SCHEMA)
    msgs = {r.rule_id: r.message for r in ru.evaluate(df, ru.DAILY, ["id"]).collect()}
    assert msgs["daily_average"] == "Average Daily Occupied: 39.9%"
    assert msgs["daily_level_very_low.2"].endswith("30% or launch aggressive marketing campaign")
