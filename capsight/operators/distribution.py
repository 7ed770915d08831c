"""Distribution and outlier statistics per group.

Two-pass statistics (z-score and IQR outliers, histogram bins, whiskers)
first aggregate one small row per group, then join it back to the rows on
the group key through :func:`capsight.functions.joins.join_small`: the
per-group table is written to the shared checkpoint folder, measured, and
broadcast only under the size bound (a shuffled join, with AQE splitting
skewed partitions, beyond it), so the rows themselves are not shuffled for
the join. The final counts are again partial aggregates.

The value of a group is the non-NULL values of the metric (NULLs are
dropped before any statistic, as the reference does).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.functions.exprs import HIST_BINS, KDE_POINTS, bias_corrected_skew, nan_to_null, skew_class
from capsight.functions.joins import join_small, materialize
from capsight.functions.missing import missing_aware
from capsight.operators.quantiles import stats_with_quantiles
from capsight.session import ship_package


def _values(df: DataFrame, group: str | None, value: str) -> DataFrame:
    keys = [group] if group else []
    out = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    return out.where(F.col(group).isNotNull()) if group else out


def _keys(group):
    return [group] if group else []


def _join_groups(a: DataFrame, b: DataFrame, group: str | None) -> DataFrame:
    """Two per-group tables side by side (one row each without a group)."""
    if group:
        return a.join(b, group)
    one = F.lit(0).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


@missing_aware
def distribution_stats(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """D1 + D2 + D8: n, mean, median, sample std, min, max, range, bias-
    corrected skewness (NULL for n < 3, 0 for a constant), skew class."""
    x = F.col("x")
    s = stats_with_quantiles(
        _values(df, group, value), _keys(group), "x",
        [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
         nan_to_null(F.stddev_samp(x)).alias("std"), F.min(x).alias("min"),
         F.max(x).alias("max"), F.skewness(x).alias("_g1")], [0.5], ["median"])
    n = F.col("n").cast("double")
    skew = nan_to_null(bias_corrected_skew(F.col("_g1"), n, F.col("std")))
    return s.select(*_keys(group), "n", "mean", "median", "std", "min", "max",
                    (F.col("max") - F.col("min")).alias("range"), skew.alias("skewness")) \
            .withColumn("skew_class", skew_class("skewness"))


def _with_stats(df: DataFrame, group: str | None, value: str, stats: DataFrame) -> DataFrame:
    """Rows (group, x) with their group's statistics (``stats`` already
    materialized): a checked broadcast of the per-group table, a shuffled
    join beyond the size bound."""
    v = _values(df, group, value)
    if group:
        return join_small(v, stats, group, materialized=True)
    one = F.lit(0).alias("_one")          # the single stats row, joined on a constant
    return join_small(v.select("*", one), stats.select("*", one), "_one",
                      materialized=True).drop("_one")


def _quartiles(df: DataFrame, group: str | None, value: str) -> DataFrame:
    x = F.col("x")
    s = stats_with_quantiles(
        _values(df, group, value), _keys(group), "x",
        [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
         nan_to_null(F.stddev_samp(x)).alias("std")],
        [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return s.select(*_keys(group), "n", "mean", "std", "q1", "median", "q3") \
            .withColumn("iqr", F.col("q3") - F.col("q1")) \
            .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
            .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))


@missing_aware
def outliers_zscore(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """D3: rows with |x - mean| / std > 3 (strict); none when std is 0 or NULL."""
    x = F.col("x")
    st = materialize(_values(df, group, value).groupBy(*_keys(group)).agg(
        F.avg(x).alias("mean"), nan_to_null(F.stddev_samp(x)).alias("std")))
    j = _with_stats(df, group, value, st)
    z = F.abs(F.col("x") - F.col("mean")) > 3 * F.col("std")
    return j.groupBy(*_keys(group)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce((F.col("std") > 0) & z, F.lit(False))).alias("outliers_3sigma"))


@missing_aware
def outliers_iqr(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """D4 + D5: quartiles, IQR, count and share of rows strictly outside
    [Q1 - 1.5 IQR, Q3 + 1.5 IQR], and the high-outlier flag (> 10 %)."""
    st = materialize(_quartiles(df, group, value))
    j = _with_stats(df, group, value, st.select(*_keys(group), "lower_fence", "upper_fence"))
    out = (F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))
    cnt = j.groupBy(*_keys(group)).agg(F.count_if(out).alias("outliers"))
    r = _join_groups(st, cnt, group)
    return r.select(*_keys(group), "n", "q1", "q3", "iqr", "outliers",
                    (F.col("outliers") / F.col("n") * 100).alias("outlier_pct"),
                    (F.col("outliers") > F.col("n") * 0.1).alias("high_outliers"))


@missing_aware
def outlier_rows(df: DataFrame, group: str | None, value: str, keep: list[str]) -> DataFrame:
    """The rows outside the IQR fences, with their z-score flag."""
    st = materialize(_quartiles(df, group, value)).select(*_keys(group), "lower_fence",
                                                          "upper_fence", "mean", "std")
    base = df.where(F.col(value).isNotNull())
    if group:
        base = base.where(F.col(group).isNotNull())
        j = join_small(base, st, group, materialized=True)
    else:
        one = F.lit(0).alias("_one")
        j = join_small(base.select("*", one), st.select("*", one), "_one",
                       materialized=True).drop("_one")
    x = F.col(value).cast("double")
    return (j.where((x < F.col("lower_fence")) | (x > F.col("upper_fence")))
             .select(*_keys(group), *keep,
                     F.when(x < F.col("lower_fence"), "low").otherwise("high").alias("side"),
                     F.coalesce((F.col("std") > 0) & (F.abs(x - F.col("mean")) > 3 * F.col("std")),
                                F.lit(False)).alias("beyond_3sigma")))


@missing_aware
def boxplot_stats(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """Quartiles, median, whiskers at the last datum inside the fences,
    and the number of fliers."""
    st = materialize(_quartiles(df, group, value))
    j = _with_stats(df, group, value, st.select(*_keys(group), "lower_fence", "upper_fence"))
    x = F.col("x")
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    w = j.groupBy(*_keys(group)).agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"))
    r = _join_groups(st, w, group)
    return r.select(*_keys(group), "n", "q1", "median", "q3", "iqr", "whisker_low",
                    "whisker_high", "fliers")


@missing_aware
def histogram(df: DataFrame, group: str | None, value: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed; a constant
    range is widened to [v - 0.5, v + 0.5]); empty bins are listed with 0.

    A value's bin is floor((x - lo) * bins / (hi - lo)), clipped to the last
    bin and corrected against the bin edges lo + k * (hi - lo) / bins.
    """
    x = F.col("x")
    mm = _values(df, group, value).groupBy(*_keys(group)).agg(F.min(x).alias("_mn"),
                                                              F.max(x).alias("_mx"))
    flat = F.col("_mn") == F.col("_mx")
    st = materialize(mm.select(
        *_keys(group), F.when(flat, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(flat, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi")))
    j = _with_stats(df, group, value, st)
    lo, hi = F.col("lo"), F.col("hi")
    step = (hi - lo) / bins
    b0 = F.least(F.lit(bins - 1), F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))))
    b1 = F.when(x < lo + b0 * step, b0 - 1).otherwise(b0)
    b2 = F.when((x >= lo + (b1 + 1) * step) & (b1 != bins - 1), b1 + 1).otherwise(b1)
    counts = j.groupBy(*_keys(group), b2.cast("long").alias("bin")) \
              .agg(F.count(F.lit(1)).alias("count"))
    grid = st.select(*_keys(group), "lo", "hi",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("long"))
    out = grid.join(counts, [*_keys(group), "bin"], "left")
    return out.select(*_keys(group), "bin",
                      (lo + F.col("bin") * step).alias("bin_lo"),
                      F.when(F.col("bin") == bins - 1, hi)
                       .otherwise(lo + (F.col("bin") + 1) * step).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


# Group densities one task sums at a time (KDE_POINTS doubles each).
_KDE_GROUPS = 2000


# Beyond this many bandwidths exp(-z * z / 2) is exactly 0 in double precision
# (it is from 38.7 on).
KERNEL_REACH = 39.0


def kernel_windows(x, h: float, lo: float, step: float, points: int):
    """Pieces of the sorted values ``x`` with the grid points they reach, as
    (i, j, a, b): the kernels of x[i:j] are 0 outside the points a to b - 1.
    A piece spans at most about one kernel and holds at most 512 values, so
    the terms worked out fall with the range over the bandwidth; values that
    reach no point of the grid are in no piece."""
    import numpy as np
    a = np.clip(np.ceil((x - KERNEL_REACH * h - lo) / step), 0, points).astype(np.int64)
    b = np.clip(np.floor((x + KERNEL_REACH * h - lo) / step) + 1, 0, points).astype(np.int64)
    width = max(1, int(min(2 * KERNEL_REACH * h / step, points)))
    cell = np.where(a < b, b // width, -1)
    edges = np.flatnonzero(np.diff(cell)) + 1
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True):
        if cell[i] < 0:
            continue
        for k in range(i, j, 512):
            end = min(k + 512, j)
            yield k, end, int(a[k]), int(b[end - 1])


def _kernel_job(points: int):
    """Partial kernel sums (g, point, s) of the rows (g, x, cnt, h, lo, step):
    one row per group and point from each task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        k = np.arange(points)

        def rows(sums):
            for g, s in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * points, pa.string()), pa.array(k), pa.array(s)], names=["g", "k", "s"])

        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").dictionary_encode(null_encoding="encode")
            names, codes = g.dictionary.to_pylist(), g.indices.to_numpy(zero_copy_only=False)
            x, cnt, h, lo, step = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "cnt", "h", "lo", "step"))
            order = np.lexsort((x, codes))
            codes, x, cnt = codes[order], x[order], cnt[order].astype(float)
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for s0, s1 in zip(starts, [*starts[1:], len(codes)], strict=True):
                at = order[s0]
                gx, gc, grid = x[s0:s1], cnt[s0:s1], lo[at] + k * step[at]
                s = sums.setdefault(names[codes[s0]], np.zeros(points))
                for i, j, a, b in kernel_windows(gx, h[at], lo[at], step[at], points):
                    z = (grid[a:b, None] - gx[i:j]) / h[at]
                    s[a:b] += np.exp(-0.5 * z * z) @ gc[i:j]
            if len(sums) > _KDE_GROUPS:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)
    return run


@missing_aware
def kde(df: DataFrame, group: str | None, value: str, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth h = std * n^(-1/5)) on
    ``points`` evenly spaced x from min - range/2 to max + range/2.

    Exact: rows are collapsed to (group, value, count), every task sums the
    kernels of its sorted values in Arrow batches over the grid points they
    reach (beyond 39 bandwidths a kernel is 0 in double precision) and puts
    out one row per group and point, and these partial sums are added. Groups
    with fewer than two values or zero spread have no density.
    """
    x = F.col("x")
    ship_package(df.sparkSession)
    vals = _values(df, group, value)
    vc = vals.groupBy(*_keys(group), "x").agg(F.count(F.lit(1)).alias("cnt"))
    st = vals.groupBy(*_keys(group)).agg(
        F.count(F.lit(1)).alias("n"), nan_to_null(F.stddev_samp(x)).alias("std"),
        F.min(x).alias("mn"), F.max(x).alias("mx"))
    st = st.select(*_keys(group), "n",
                   (F.col("std") * F.pow(F.col("n").cast("double"), -0.2)).alias("h"),
                   (F.col("mn") - 0.5 * (F.col("mx") - F.col("mn"))).alias("lo"),
                   (F.col("mx") + 0.5 * (F.col("mx") - F.col("mn"))).alias("hi"))
    ok = (F.col("n") >= 2) & (F.col("h") > 0)
    st = materialize(st.withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1)).where(ok))
    if group:
        j = join_small(vc, st, group, materialized=True)
    else:
        one = F.lit(0).alias("_one")
        j = join_small(vc.select("*", one), st.select("*", one), "_one",
                       materialized=True).drop("_one")
    name = F.col(group).cast("string") if group else F.lit("")
    sums = (j.select(name.alias("g"), "x", "cnt", "h", "lo", "step")
            .mapInArrow(_kernel_job(points), "g string, k long, s double")
            .groupBy("g", "k").agg(F.sum("s").alias("_s")).withColumnsRenamed({"g": "_g", "k": "_k"}))
    grid = st.select(*_keys(group), name.alias("_g"), "lo", "step", "n", "h",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("_k"))
    out = grid.join(sums, ["_g", "_k"], "left")
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return out.select(*_keys(group), F.col("_k").alias("point"),
                      (F.col("lo") + F.col("_k") * F.col("step")).alias("x"),
                      (F.coalesce(F.col("_s"), F.lit(0.0)) / norm).alias("density"))


@missing_aware
def chart_distribution(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """Histogram bars, density curve and mean / median markers in one
    long table (layer, x, y)."""
    k = _keys(group)
    h = histogram(df, group, value).select(
        *k, F.lit("histogram").alias("layer"), ((F.col("bin_lo") + F.col("bin_hi")) / 2).alias("x"),
        F.col("count").cast("double").alias("y"))
    d = kde(df, group, value).select(*k, F.lit("density").alias("layer"), "x",
                                     F.col("density").alias("y"))
    s = distribution_stats(df, group, value)
    m = s.select(*k, F.inline(F.array(
        F.struct(F.lit("mean").alias("layer"), F.col("mean").alias("x"),
                 F.lit(None).cast("double").alias("y")),
        F.struct(F.lit("median").alias("layer"), F.col("median").alias("x"),
                 F.lit(None).cast("double").alias("y")))))
    return h.unionByName(d).unionByName(m)
