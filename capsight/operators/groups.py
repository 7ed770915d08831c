"""Grouped comparison.

All groups are aggregated in one ``groupBy`` (partial aggregation on the
map side, so a hot group costs one partial row per input partition). Group
summaries that look across groups (best / worst, concentration) are a
second, tiny aggregate over the grouped result; ties go to the smallest key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.functions.exprs import nan_to_null
from capsight.functions.missing import missing_aware

# Aggregates accepted by compare_groups, by name (pandas spellings).
AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "median": lambda c: F.percentile(c, 0.5),
    "std": lambda c: nan_to_null(F.stddev_samp(c)),
    "var": lambda c: nan_to_null(F.var_samp(c)),
    "nunique": F.count_distinct,
}


def _check(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {missing}; available: {', '.join(df.columns)}")


@missing_aware
def compare_groups(df: DataFrame, group: str, value: str, metric: str = "sum") -> DataFrame:
    """One aggregate of ``value`` per non-null group, ordered by the
    value descending, then key. The sum of an all-NULL group is 0."""
    _check(df, group, value)
    if metric not in AGGREGATES:
        raise ValueError(f"unknown metric {metric!r}; use one of {sorted(AGGREGATES)}")
    src = df.where(F.col(group).isNotNull())
    if metric == "median":   # exact even for a huge group (order-statistic selection)
        from capsight.operators.quantiles import stats_with_quantiles
        out = stats_with_quantiles(src, [group], value, [F.count(F.lit(1)).alias("_n")], [0.5],
                                   ["value"]).select(group, "value")
    else:
        out = src.groupBy(group).agg(AGGREGATES[metric](F.col(value)).alias("value"))
    return out.orderBy(F.desc_nulls_last("value"), F.asc(group))


@missing_aware
def group_totals(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum by group, descending."""
    return compare_groups(df, group, value, "sum")


@missing_aware
def compare_groups_summary(grouped: DataFrame, group: str) -> DataFrame:
    """Total and mean of the group results, and the top group."""
    v = F.col("value").cast("double")
    return grouped.agg(
        F.sum(v).alias("total"), F.avg(v).alias("average"),
        F.count(F.lit(1)).alias("groups"),
        F.min_by(F.col(group), F.struct(-v, F.col(group))).alias("top_group"),
        F.max(v).alias("top_value"))


@missing_aware
def top_groups(grouped: DataFrame, group: str, k: int = 10) -> DataFrame:
    """L3: the first k groups of a comparison (a distributed top-k)."""
    return grouped.orderBy(F.desc_nulls_last("value"), F.asc(group)).limit(k)


@missing_aware
def group_multi_agg(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum, mean and non-null count per group."""
    c = F.col(value)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("sum"), F.avg(c).alias("mean"),
        F.count(c).alias("count"))


@missing_aware
def best_worst_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """A13 + A14: best and worst group by sum (ties: smallest key) and the
    performance gap (best - worst) / best * 100."""
    s = F.col("sum").cast("double")
    g = F.col(group)
    bw = group_multi_agg(df, group, value).agg(
        F.min_by(g, F.struct(-s, g)).alias("best_group"), F.max(s).alias("best_value"),
        F.min_by(g, F.struct(s, g)).alias("worst_group"), F.min(s).alias("worst_value"))
    gap = F.try_divide(F.col("best_value") - F.col("worst_value"), F.col("best_value")) * 100
    return bw.withColumn("gap_pct", nan_to_null(gap))


@missing_aware
def group_concentration(df: DataFrame, group: str, value: str) -> DataFrame:
    """Top group, its value and share of the total, and the mean /
    min / max over the group sums."""
    s = F.col("value").cast("double")
    g = F.col(group)
    out = group_totals(df, group, value).agg(
        F.min_by(g, F.struct(-s, g)).alias("top_group"), F.max(s).alias("top_value"),
        F.sum(s).alias("total"), F.avg(s).alias("mean"), F.min(s).alias("min"),
        F.max(s).alias("max"))
    return out.withColumn("top_share_pct",
                          nan_to_null(F.try_divide(F.col("top_value"), F.col("total")) * 100))


@missing_aware
def group_cards(df: DataFrame, group: str, primary: str, secondary: str) -> DataFrame:
    """Per group totals and means of both metrics and the row count."""
    p, s = F.col(primary), F.col(secondary)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.coalesce(F.sum(p), F.lit(0)).alias(f"total_{primary}"),
        F.coalesce(F.sum(s), F.lit(0)).alias(f"total_{secondary}"),
        F.avg(p).alias(f"avg_{primary}"), F.avg(s).alias(f"avg_{secondary}"),
        F.count(F.lit(1)).alias("rows"))


STAT_ORDER = ["total", "count", "mean", "std", "min", "25%", "50%", "75%", "max"]


@missing_aware
def group_summary(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """A5: per group and column: total first, then count, mean, std, min,
    quartiles and max (pandas ``describe`` plus a total row), long form
    (group, column, stat_order, stat, value).

    The columns are unpivoted first, so one grouped plan on (group, column)
    serves every column, and quartiles stay exact for huge groups
    (:mod:`capsight.operators.quantiles`)."""
    from capsight.operators.quantiles import stats_with_quantiles
    _check(df, group, *cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                      for c in cols])
    long = df.where(F.col(group).isNotNull()).select(group, F.inline(pairs))
    v = F.col("v")
    st = stats_with_quantiles(
        long, [group, "column"], "v",
        [F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).cast("double").alias("count"),
         F.avg(v).alias("mean"), nan_to_null(F.stddev_samp(v)).alias("std"),
         F.min(v).alias("min"), F.max(v).alias("max")],
        [0.25, 0.5, 0.75], ["25%", "50%", "75%"])
    cells = F.array(*[F.struct(F.lit(j).cast("long").alias("stat_order"), F.lit(name).alias("stat"),
                               F.col(f"`{name}`").alias("value"))
                      for j, name in enumerate(STAT_ORDER)])
    return st.select(group, "column", F.inline(cells))
