"""Time-series operators: row order, per-group trends, daily resampling, gap fill.

Scale notes
-----------
* A window over every row of a group would sort a whole (possibly huge,
  skewed) group in one task. Row positions (T2) are therefore computed in
  the *bucket-offset* form: rows are counted per (group, hour bucket), a
  prefix sum over those few bucket counts gives each bucket's offset, and
  only the rows of one bucket are ranked together. A hot group is spread
  over as many tasks as it has hour buckets; a single over-full bucket
  switches the job to a range-partitioned plan (:func:`row_index`).
* Trend coefficients are plain aggregates (``regr_slope``,
  ``regr_intercept``, a guarded covariance ratio for r) with map-side
  partial aggregation: no row moves for them beyond the ranking shuffle.
* The daily series has one row per group and day, so windows over it are
  bounded by the number of days, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from capsight.functions.exprs import (safe_corr, direction, nan_to_null, ratio_pct,
                                      strength_r2, utilization_pct)
from capsight.functions.joins import join_small, stage
from capsight.functions.missing import missing_aware
from capsight.roles import Roles


def _grouped(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows that belong to a group: NULL group keys are left out, as a
    group-by over the key would. Raises ValueError naming any role column
    the table lacks."""
    roles.check(df)
    return df.where(F.col(roles.group).isNotNull()) if roles.group else df


# ---------------------------------------------------------------------------
# Row position in date order, per group

# Bucket of a NULL date: sorts before every real hour.
_NULL_BUCKET = -(1 << 40)


def _hour_bucket(c) -> F.Column:
    """Whole hours since 1970-01-01 of a date / timestamp (wall clock), as a
    BIGINT that sorts like the date; NULL dates get the lowest bucket."""
    c = F.col(c) if isinstance(c, str) else c
    h = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 24 \
        + F.hour(c).cast("long")
    return F.coalesce(h, F.lit(_NULL_BUCKET).cast("long"))


def _bucket_offsets(df: DataFrame, roles: Roles) -> tuple[DataFrame, DataFrame]:
    """Rows with their hour bucket, and the per (group, bucket) table of row
    count ``_n``, rows before the bucket ``_offset`` and ``group_rows``."""
    keys = roles.keys
    d = _grouped(df, roles).withColumn("_bucket", _hour_bucket(roles.date))
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = counts.select(*keys, "_bucket", "_n",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(whole).alias("group_rows"))
    return d, offsets


def _order(roles: Roles) -> list:
    return [F.col(roles.date).asc_nulls_first()] + [F.col(k).asc_nulls_first()
                                                   for k in roles.order_key]


# Largest (group, hour) bucket ranked by one task; beyond it row positions
# come from a range-partitioned plan.
HOT_BUCKET_ROWS = 20_000_000


@missing_aware
def row_index(df: DataFrame, roles: Roles, method: str | None = None) -> DataFrame:
    """Add ``row_index`` = 0..n-1 in (date, order key) order within each group,
    and ``group_rows`` = n.

    Rows with a NULL date sort first (as a NULL-first sort would); ties on
    the date are broken by ``roles.order_key``.

    ``bucket`` plan: rows are shuffled once, on (group, hour bucket); that
    partitioning serves both the join with the bucket offsets and the
    ranking window, so a hot group is spread over its hours. ``range``
    plan: for a single hour holding too many rows, rows are range
    partitioned on (group, date, key) -- sampled bounds split even one hot
    bucket over many tasks -- and positions come from the partition order
    plus per-(partition, group) offsets. ``auto`` (default; session conf
    ``capsight.rowindex.method``) checks the largest bucket (one small
    aggregate) and picks ``bucket`` unless it exceeds ``HOT_BUCKET_ROWS``.
    """
    method = method or df.sparkSession.conf.get("capsight.rowindex.method", "auto")
    keys = roles.keys
    d, offsets = _bucket_offsets(df, roles)
    if method == "auto":
        method = "bucket" if _largest_bucket(offsets) <= HOT_BUCKET_ROWS else "range"
    if method == "range":
        return _row_index_range(df, roles)
    if method != "bucket":
        raise ValueError(f"unknown row index method {method!r}: use auto, bucket or range")
    in_bucket = W.partitionBy(*keys, "_bucket").orderBy(*_order(roles))
    j = d.join(offsets.drop("_n"), [*keys, "_bucket"])
    return (j.withColumn("row_index", (F.col("_offset") + F.row_number().over(in_bucket) - 1)
                         .cast("long"))
             .drop("_bucket", "_offset"))


def _largest_bucket(offsets: DataFrame) -> int:
    """Rows of the largest (group, hour) bucket (one small aggregate); it only
    chooses the plan, never a result."""
    return offsets.agg(F.max("_n")).first()[0] or 0


def _row_index_range(df: DataFrame, roles: Roles) -> DataFrame:
    """Row positions from a range-partitioned sort (see :func:`row_index`).

    After ``repartitionByRange`` + ``sortWithinPartitions`` on (group, date,
    key), the rows of a group inside one partition are contiguous and in
    order, so ``monotonically_increasing_id`` minus the group's first id in
    that partition is its local rank. The ranked rows are written once to
    the shared checkpoint folder (both following passes read them, and the
    positions never change on recompute); the per-(partition, group) counts
    give each piece's offset by a prefix sum over the partitions, joined
    back with a checked broadcast.
    """
    keys = roles.keys
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [*[F.col(k) for k in keys], *_order(roles)]
    d = _grouped(df, roles)
    ranged = (d.repartitionByRange(parts, *order).sortWithinPartitions(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_pos", F.monotonically_increasing_id()))
    staged = stage(ranged, ranged.columns, "rowindex")
    pieces = staged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"),
                                                F.min("_pos").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    off = pieces.select(*keys, "_pid", "_first",
                        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                        F.sum("_n").over(W.partitionBy(*keys)).alias("group_rows"))
    j = join_small(staged, off, [*keys, "_pid"])
    return (j.withColumn("row_index",
                         (F.col("_offset") + F.col("_pos") - F.col("_first")).cast("long"))
             .drop("_pid", "_pos", "_first", "_offset"))


@missing_aware
def edge_rows(df: DataFrame, roles: Roles, k: int = 3) -> DataFrame:
    """The first k and last k rows of every group (date + key order), with
    ``row_index`` and ``group_rows``.

    Only the hour buckets that hold those rows (at most 2k per group, from
    the small offsets table) are kept, through a checked-broadcast join, and
    only k rows per bucket and side are ranked: the ``row_number() <= k``
    filters are planned as a window group limit, which keeps k rows per
    bucket in every task before the shuffle, so even a hot boundary bucket
    moves only k rows per task.
    """
    keys = roles.keys
    d, offsets = _bucket_offsets(df, roles)
    o, n, g = F.col("_offset"), F.col("_n"), F.col("group_rows")
    edges = offsets.where((o < k) | (o + n > g - k))
    j = join_small(d, edges, [*keys, "_bucket"])
    fwd = W.partitionBy(*keys, "_bucket").orderBy(*_order(roles))
    bwd = W.partitionBy(*keys, "_bucket").orderBy(
        *[c.desc_nulls_last() for c in
          [F.col(roles.date)] + [F.col(c) for c in roles.order_key]])
    first = (j.where(o < k).withColumn("_rn", F.row_number().over(fwd)).where(F.col("_rn") <= k)
              .withColumn("row_index", (o + F.col("_rn") - 1).cast("long"))
              .where(F.col("row_index") < k))
    last = (j.where(o + n > g - k).withColumn("_rn", F.row_number().over(bwd))
             .where(F.col("_rn") <= k)
             .withColumn("row_index", (o + n - F.col("_rn")).cast("long"))
             .where((F.col("row_index") >= g - k) & (F.col("row_index") >= k)))
    return (first.unionByName(last)
                 .drop("_bucket", "_offset", "_n", "_rn"))


# ---------------------------------------------------------------------------
# Linear trend per group and metric (x = row position, NULL -> 0)

# Position within a partition: the low bits of monotonically_increasing_id.
_POSITION_BITS = (1 << 33) - 1


def _trend_pieces(df: DataFrame, roles: Roles, metrics: list[str]) -> DataFrame:
    """Per range partition and group: number of rows and, for metric i (NULL
    -> 0), ``_m{i}`` = mean, y2 = sum (y - mean)^2, c = sum (x - mean x)(y -
    mean) over positions x in the piece, lo, hi, first and last value."""
    keys = roles.keys
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [*[F.col(k) for k in keys], *_order(roles)]
    need = list(dict.fromkeys([*keys, roles.date, *roles.order_key, *metrics]))
    ranged = (_grouped(df, roles).select(*need).repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS))))
    x, n = F.col("_pos"), F.count(F.lit(1))

    def moments(m):
        y = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
        return F.struct(F.avg(y).alias("mean"), (F.var_pop(y) * n).alias("y2"),
                        (F.covar_pop(y, x.cast("double")) * n).alias("c"), F.min(y).alias("lo"), F.max(y).alias("hi"),
                        F.min_by(y, x).alias("first"), F.max_by(y, x).alias("last"))

    return ranged.groupBy("_pid", *keys).agg(n.alias("_n"),
                                             *[moments(m).alias(f"_m{i}") for i, m in enumerate(metrics)])


def _joined_moments(pieces: F.Column, field: str) -> F.Column:
    """Moments of a whole group from its pieces in order. Joining a piece of k
    rows to n rows before it moves their mean positions (n + k) / 2 apart."""
    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f) for f in ("mean", "y2", "c")],
                     *[F.lit(None).cast("double").alias(f) for f in ("lo", "hi")])

    def join(s, p):
        n, k, q = s["n"], p["_n"], p[field]
        total = (n + k).cast("double")
        d = F.when(n > 0, q["mean"] - s["mean"]).otherwise(F.lit(0.0))
        both = n * (k / total)
        return F.struct((n + k).alias("n"), F.when(n > 0, s["mean"] + d * (k / total)).otherwise(q["mean"]).alias("mean"),
                        (s["y2"] + q["y2"] + d * d * both).alias("y2"), (s["c"] + q["c"] + d * both * total / 2).alias("c"),
                        F.least(s["lo"], q["lo"]).alias("lo"), F.greatest(s["hi"], q["hi"]).alias("hi"))

    return F.aggregate(pieces, start, join)


@missing_aware
def trend_regression(df: DataFrame, roles: Roles, metrics: list[str] | None = None) -> DataFrame:
    """Per (group, metric): n, slope, intercept, r, r2, first, last, change_pct,
    direction, strength. Groups with n <= 1 get NULL statistics and
    direction ``unknown``.

    A metric whose values do not vary has r = 0 and r2 = 0 (least squares
    with zero variance in y), never 1. The rows move once, range partitioned
    in (group, date, key) order, so a hot group or hour spreads over tasks.
    Each piece (the rows of a group in one partition) gives its moments with
    positions of its own, and the pieces, at most partitions + groups in all,
    are joined in order: no row needs its position in the group.
    """
    metrics = metrics or [roles.primary, roles.secondary]
    present = [m for m in metrics if m in df.columns]
    if not present:
        raise ValueError(f"none of the metrics {metrics} is a column; available: {df.columns}")
    pieces = _trend_pieces(df, roles, present)
    per_group = pieces.groupBy(*roles.keys).agg(F.array_sort(F.collect_list(F.struct(
        "_pid", "_n", *[f"_m{i}" for i in range(len(present))]))).alias("_p"))
    first, last = F.element_at("_p", 1), F.element_at("_p", -1)
    g = per_group.select(*roles.keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), _joined_moments(F.col("_p"), f"_m{i}").alias("_t"),
                 first[f"_m{i}"]["first"].alias("first_value"), last[f"_m{i}"]["last"].alias("last_value"))
        for i, m in enumerate(present)])))
    n, c = F.col("_t.n"), F.col("_t.c")
    ok = n > 1
    x2 = F.col("_t.n").cast("double") * (n * F.col("_t.n").cast("double") - 1) / 12  # sum of (x - mean)^2, x = 0..n-1
    slope = nan_to_null(F.try_divide(c, x2))
    r = nan_to_null(F.try_divide(c, F.sqrt(x2) * F.sqrt(F.col("_t.y2"))))
    out = g.select(
        *roles.keys, "metric", n.alias("n"),
        F.when(ok, slope).alias("slope"),
        F.when(ok, nan_to_null(F.col("_t.mean") - slope * (n - 1) / 2)).alias("intercept"),
        F.when(~ok, None).when(F.col("_t.lo") == F.col("_t.hi"), 0.0).otherwise(r).alias("r"),
        "first_value", "last_value",
        F.when(~ok, None).when(F.col("first_value") != 0,
                               (F.col("last_value") - F.col("first_value"))
                               / F.col("first_value") * 100).otherwise(0.0).alias("change_pct"))
    out = out.select(*roles.keys, "metric", "n", "slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r2"),
                     "first_value", "last_value", "change_pct")
    return (out.withColumn("direction", direction(F.col("slope")))
               .withColumn("strength", F.when(F.col("n") > 1, strength_r2(F.col("r2")))))


@missing_aware
def trend_line(df: DataFrame, roles: Roles, metrics: list[str] | None = None) -> DataFrame:
    """Every row with its position and fitted value per metric.

    The rows are ranked once and written to the shared checkpoint folder. The
    coefficients of all metrics are aggregated side by side over them (one
    pass, one row per group), turned into a small (group,
    metric) table and joined back with a checked broadcast (a shuffled join
    beyond the size bound).
    """
    metrics = metrics or [roles.primary, roles.secondary]
    present = [m for m in metrics if m in df.columns]
    if not present:
        raise ValueError(f"none of the metrics {metrics} is a column; available: {df.columns}")
    need = list(dict.fromkeys([*roles.keys, roles.date, *roles.order_key, *present]))
    idx = row_index(df.select(*need), roles)
    # both passes below read the ranked rows: written once, ranked once
    idx = stage(idx, [*need, "row_index"], "trend")
    x = F.col("row_index").cast("double")
    ys = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in present]
    wide = idx.groupBy(*roles.keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[e for i, y in enumerate(ys) for e in (F.regr_slope(y, x).alias(f"_s{i}"),
                                                F.regr_intercept(y, x).alias(f"_i{i}"))])
    coef = wide.select(*roles.keys, "_n", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_s{i}").alias("_slope"),
                 F.col(f"_i{i}").alias("_icpt")) for i, m in enumerate(present)])))
    long = idx.select(*roles.keys, roles.date, *roles.order_key, "row_index", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), y.alias("value")) for m, y in zip(present, ys)])))
    j = join_small(long, coef, [*roles.keys, "metric"])
    return j.select(*roles.keys, roles.date, *roles.order_key, "row_index", "metric", "value",
                    F.when(F.col("_n") > 1, nan_to_null(F.col("_icpt") + F.col("_slope") * x))
                     .alias("fitted"))


@missing_aware
def recent_vs_earlier(df: DataFrame, roles: Roles, value: str | None = None,
                      k: int = 3) -> DataFrame:
    """Mean of the last k vs the first k rows (date + key order) per group,
    of row utilization by default."""
    src = df if value else df.withColumn(
        "_util", utilization_pct(roles.primary, roles.secondary))
    v = value or "_util"
    idx = edge_rows(src, roles, k)
    i, n = F.col("row_index"), F.col("group_rows")
    return idx.groupBy(*roles.keys).agg(
        F.max("group_rows").alias("n"),
        F.avg(F.when(i < k, F.col(v))).alias("earlier_mean"),
        F.avg(F.when(i >= n - k, F.col(v))).alias("recent_mean"))


# ---------------------------------------------------------------------------
# Daily resampling and forward fill

@missing_aware
def daily_mean(df: DataFrame, roles: Roles) -> DataFrame:
    """Per group and calendar day, the mean of row utilization (a mean of
    ratios), the means of both metrics, their sums and the row count."""
    a, c = F.col(roles.primary), F.col(roles.secondary)
    src = _grouped(df, roles).where(F.col(roles.date).isNotNull())
    return src.groupBy(*roles.keys, F.to_date(roles.date).alias("day")).agg(
        F.avg(utilization_pct(a, c)).alias("occupied_pct"),
        F.avg(a.cast("double")).alias(roles.primary),
        F.avg(c.cast("double")).alias(roles.secondary),
        F.sum(a.cast("double")).alias("_sum_a"),
        F.sum(c.cast("double")).alias("_sum_c"),
        F.count(F.lit(1)).alias("rows"))


@missing_aware
def daily_ffill(df: DataFrame, roles: Roles) -> DataFrame:
    """T9 + T10: one row per group and day from its first to its last day;
    a missing day, and a missing value on a present day, carry the last
    value seen before them (per column)."""
    return fill_days(with_sum_ratio(daily_mean(df, roles)), roles)


@missing_aware
def with_sum_ratio(daily: DataFrame) -> DataFrame:
    """The ratio of the daily sums next to the mean of the ratios."""
    return daily.withColumn(
        "sum_ratio_pct", F.when(F.col("_sum_a").isNull() & F.col("_sum_c").isNull(), None)
        .otherwise(ratio_pct(F.coalesce("_sum_a", F.lit(0.0)), F.coalesce("_sum_c", F.lit(0.0)))))


@missing_aware
def fill_days(daily: DataFrame, roles: Roles, max_gap: int | None = None) -> DataFrame:
    """T10 on a daily table (keys, day, occupied_pct, metric means,
    sum_ratio_pct, rows).

    Done without a calendar join: after a last-non-NULL fill over the
    present days, each present day is expanded over the days up to the next
    present day (``lead`` + ``sequence`` + ``explode``). With ``max_gap`` a
    longer gap (days) raises instead of being filled.
    """
    values = ["occupied_pct", roles.primary, roles.secondary, "sum_ratio_pct"]
    upto = W.partitionBy(*roles.keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    nxt = W.partitionBy(*roles.keys).orderBy("day")
    filled = daily.select(
        *roles.keys, "day", "rows",
        *[F.last(v, ignorenulls=True).over(upto).alias(v) for v in values],
        F.lead("day").over(nxt).alias("_next"))
    span = (F.when(F.col("_next").isNull(), F.array(F.col("day")))
             .otherwise(F.sequence(F.col("day"), F.date_sub(F.col("_next"), 1))))
    if max_gap is not None:
        gap = F.datediff(F.col("_next"), F.col("day"))
        too_long = F.raise_error(F.concat(F.lit(f"gap of more than {max_gap} days to fill after "),
                                          F.col("day").cast("string"))).cast("array<date>")
        span = F.when(gap > max_gap, too_long).otherwise(span)
    out = filled.select(*roles.keys, F.explode(span).alias("_d"), "day", "rows", *values)
    is_filled = F.col("_d") != F.col("day")
    return out.select(*roles.keys, F.col("_d").alias("day"),
                      *values,
                      F.when(is_filled, F.lit(0)).otherwise(F.col("rows")).cast("long").alias("rows"),
                      is_filled.alias("is_filled"))


@missing_aware
def peak_low_day(daily: DataFrame, roles: Roles, value: str = "occupied_pct") -> DataFrame:
    """First day of the maximum and of the minimum, per group."""
    v, d = F.col(value), F.col("day")
    return daily.groupBy(*roles.keys).agg(
        F.max(v).alias("peak_value"),
        F.min_by(d, F.struct(-v, d)).alias("peak_day"),
        F.min(v).alias("low_value"),
        F.min_by(d, F.struct(v, d)).alias("low_day"))


@missing_aware
def daily_caption(daily: DataFrame, roles: Roles, value: str = "occupied_pct") -> DataFrame:
    """Average, number of days and chart top = max(max + 10, 110)."""
    v = F.col(value)
    return daily.groupBy(*roles.keys).agg(
        F.avg(v).alias("average_pct"), F.count(F.lit(1)).alias("days"),
        F.greatest(F.max(v) + 10, F.lit(110.0)).alias("y_top"))
