"""Dataset and column profiling.

Every profile is one aggregate over the table (wide ``agg`` then an
``inline`` into long form): one scan, partial aggregation on the map side,
and a single small row reaching the reduce side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.exprs import nan_to_null
from capsight.functions.joins import join_small, materialize
from capsight.functions.missing import missing_aware
from capsight.session import ship_package

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXT = (T.StringType, T.VarcharType, T.CharType)
# Fixed widths (bytes) of a value by type, for the size estimate (A2).
FIXED_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4,
               T.DateType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8,
               T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}
# Column-chunk size for very wide tables: one aggregate per chunk.
CHUNK = 50


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT)]


def date_named_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains "date" in any case (the first is the date role)."""
    return [c for c in df.columns if "date" in c.lower()]


def classify_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, type, class) from the schema alone; class is numeric,
    datetime, text or other. Booleans are not numeric."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        cls = ("numeric" if isinstance(t, NUMERIC) else "datetime" if isinstance(t, DATETIME)
               else "text" if isinstance(t, TEXT) else "other")
        out.append((f.name, t.simpleString(), cls))
    return out


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


def _long(df: DataFrame, cols: list[str], per_col, names: list[str]) -> DataFrame:
    """One wide aggregate (chunked) -> long rows (column, *names)."""
    parts = []
    for i in range(0, len(cols), CHUNK):
        chunk = cols[i:i + CHUNK]
        aggs = []
        for j, c in enumerate(chunk):
            for n, e in zip(names, per_col(c)):
                aggs.append(e.alias(f"_{j}_{n}"))
        wide = df.agg(*aggs)
        structs = F.array(*[F.struct(F.lit(c).alias("column"),
                                     *[F.col(f"_{j}_{n}").alias(n) for n in names])
                            for j, c in enumerate(chunk)])
        parts.append(wide.select(F.inline(structs)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@missing_aware
def overview(df: DataFrame) -> DataFrame:
    """A1: rows, columns, total missing cells (one pass)."""
    missing = [F.count_if(_q(c).isNull()) for c in df.columns]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing")) \
             .select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing")


@missing_aware
def data_size(df: DataFrame) -> DataFrame:
    """A2: bytes held by the values: text by UTF-8 length, others by fixed width."""
    terms = []
    for f in df.schema.fields:
        c = _q(f.name)
        if isinstance(f.dataType, TEXT):
            terms.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)))
        else:
            w = next((v for k, v in FIXED_WIDTH.items() if isinstance(f.dataType, k)), 8)
            terms.append(F.count(c) * F.lit(w))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.agg(total.cast("long").alias("bytes")) \
             .select("bytes", (F.col("bytes") / 1024.0).alias("kb"))


def _by_column(df: DataFrame, values: dict[str, F.Column], base, probs, names) -> DataFrame:
    """One stats row per column: ``base(v)`` gives (name, aggregate) pairs in
    one wide aggregate, plus exact quantiles ``names`` at ``probs`` with the
    column name as the group."""
    from capsight.operators import quantiles as qt
    base_names = [n for n, _ in base(F.col("v"))]
    stats = _long(df, list(values), lambda c: [e for _, e in base(values[c])], base_names)
    return stats.join(qt.quantiles_by_column(df, list(values), values, probs, names), "column", "left")


@missing_aware
def column_totals(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: Total, Mean, Median, Min, Max of every numeric column."""
    cols = cols or numeric_columns(df)
    out = _by_column(df, {c: _q(c).cast("double") for c in cols},
                     lambda v: [("total", F.sum(v)), ("mean", F.avg(v)), ("min", F.min(v)),
                                ("max", F.max(v))],
                     [0.5], ["median"])
    return out.select("column", "total", "mean", "median", "min", "max")


def _epoch_seconds(c: F.Column) -> F.Column:
    """Seconds since 1970-01-01 00:00 of a wall-clock (NTZ) timestamp or date,
    computed without any session time zone."""
    day = F.unix_date(F.to_date(c)).cast("double") * 86400.0
    tod = (F.hour(c) * 3600 + F.minute(c) * 60).cast("double") \
        + F.extract(F.lit("SECOND"), c).cast("double")
    return day + tod


def _value(c: str, t: T.DataType | None = None) -> F.Column:
    """Numeric value of a column; datetimes as seconds since 1970 (an
    absolute TIMESTAMP by its instant, a TIMESTAMP_NTZ / DATE by its wall
    clock read as UTC)."""
    if isinstance(t, T.TimestampType):
        return F.unix_micros(_q(c)) / 1e6
    if isinstance(t, T.TimestampNTZType):
        return _epoch_seconds(_q(c))
    if isinstance(t, T.DateType):
        return F.unix_date(_q(c)).cast("double") * 86400.0
    return _q(c).cast("double")


def _wall_clock(seconds) -> F.Column:
    """Epoch seconds back to a wall-clock timestamp, to the microsecond."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


@missing_aware
def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A4: count, mean, std, min, 25/50/75 %, max of numeric and datetime
    columns. A datetime column's statistics stand as timestamps in mean_ts,
    min_ts, p25_ts, p50_ts, p75_ts and max_ts, a numeric column's in the
    columns without the suffix; the others are NULL, as is a datetime's std.
    Exact percentiles with linear interpolation; ``describe_approx`` for a
    bounded-memory sketch instead."""
    dts = datetime_columns(df)
    cols = cols or [c for c in df.columns if c in set(numeric_columns(df)) | set(dts)]
    out = _by_column(df, {c: _value(c, df.schema[c].dataType) for c in cols},
                     lambda v: [("count", F.count(v)), ("mean", F.avg(v)),
                                ("std", nan_to_null(F.stddev_samp(v))),
                                ("min", F.min(v)), ("max", F.max(v))],
                     [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    is_date = F.col("column").isin(*dts) if dts else F.lit(False)
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return out.select("column", "count", *[F.when(~is_date, F.col(c)).alias(c) for c in stats],
                      *[F.when(is_date, _wall_clock(F.col(c))).alias(f"{c}_ts") for c in stats if c != "std"])


@missing_aware
def describe_approx(df: DataFrame, cols: list[str] | None = None,
                    accuracy: int = 10000) -> DataFrame:
    """A4 with ``percentile_approx`` (bounded memory per group at any scale)."""
    dts = set(datetime_columns(df))
    cols = cols or [c for c in df.columns if c in set(numeric_columns(df)) | dts]

    def per(c):
        v = _value(c, df.schema[c].dataType)
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        std = F.lit(None).cast("double") if c in dts else nan_to_null(F.stddev_samp(v))
        return [F.count(_q(c)), F.avg(v), std, F.min(v), q[0], q[1], q[2], F.max(v)]

    return _long(df, cols, per, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


@missing_aware
def column_profile(df: DataFrame, cols: list[str] | None = None,
                   approx_distinct: bool = False) -> DataFrame:
    """Per column type, values, missing, distinct non-null values.

    Distinct values are exact: every column's values are counted as (column,
    text) pairs with partial aggregation, so a value that fills a column is
    one row of a task. ``approx_distinct=True`` (HyperLogLog++) needs no
    shuffle of values."""
    cols = cols or df.columns
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    names = ["values", "missing"]
    per = lambda c: [F.count(F.lit(1)), F.count_if(_q(c).isNull())]
    if approx_distinct:
        out = _long(df, cols, lambda c: [*per(c), F.approx_count_distinct(_q(c))], [*names, "distinct"])
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("v")) for c in cols])
        distinct = (df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct()
                    .groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
        out = _long(df, cols, per, names).join(distinct, "column", "left")
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return out.select("column", tmap[F.col("column")].alias("type"), "values", "missing",
                      F.coalesce(F.col("distinct"), F.lit(0)).cast("long").alias("distinct"))


@missing_aware
def column_profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean, median, std, min, max of numeric columns."""
    cols = cols or numeric_columns(df)
    out = _by_column(df, {c: _q(c).cast("double") for c in cols},
                     lambda v: [("mean", F.avg(v)), ("std", nan_to_null(F.stddev_samp(v))),
                                ("min", F.min(v)), ("max", F.max(v))],
                     [0.5], ["median"])
    return out.select("column", "mean", "median", "std", "min", "max")


# top_values: values a column's frequency summary tracks, values it names for
# each of the k asked for, and buckets that count what it does not name.
SUMMARY_ITEMS, NAMED_PER_PLACE, BUCKETS = 10_000, 4, 4096


def _named(df: DataFrame, cols: list[str], k: int) -> dict[str, list[int]]:
    """Per column the hashes of its probably most frequent values, at most
    NAMED_PER_PLACE * k, from mergeable summaries (``approx_top_k``) of all rows."""
    top = NAMED_PER_PLACE * k
    out: dict[str, list[int]] = {}
    for i in range(0, len(cols), CHUNK):
        chunk = cols[i:i + CHUNK]
        hashes = df.select(*[F.when(_q(c).isNotNull(), F.xxhash64(_q(c).cast("string"))).alias(f"_{j}")
                             for j, c in enumerate(chunk)])
        r = hashes.agg(*[F.expr(f"approx_top_k(_{j}, {top}, {max(top, SUMMARY_ITEMS)})").alias(f"_{j}")
                         for j in range(len(chunk))]).first()
        out |= {c: [t["item"] for t in r[j] or [] if t["item"] is not None] for j, c in enumerate(chunk)}
    return out


@missing_aware
def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent non-null values per column (ties by value).

    A summary of every column names likely values. One pass then counts these
    exactly and all others in BUCKETS buckets of their hash, so a task puts
    out a bounded number of rows however many values there are. A bucket that
    counts less than the k-th named value holds none of the top k; only the
    values of the other buckets (all of them for a column without frequent
    values) are counted one by one. The result is exact whatever the summary
    names. The top-k filter on ``row_number`` is planned as a group limit.
    """
    cols = cols or [c for c in df.columns if c not in set(numeric_columns(df))]
    named = _named(df, cols, k)

    def cells(of: list[str]) -> DataFrame:
        """(column, value, bucket): the value of a named cell, the bucket of another."""
        parts = []
        for c in of:
            text = _q(c).cast("string")
            code = F.xxhash64(text)
            known = code.isin(named[c]) if named[c] else F.lit(False)
            parts.append(F.struct(F.lit(c).alias("column"), text.alias("value"),
                                  F.when(~known, F.pmod(code, F.lit(BUCKETS))).alias("bucket")))
        return df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())

    kept = F.when(F.col("bucket").isNull(), F.col("value")).alias("value")
    seen = materialize(cells(cols).groupBy("column", kept, "bucket").agg(F.count(F.lit(1)).alias("count")))
    counts = seen.where("bucket is null").select("column", "value", "count")
    bar = counts.groupBy("column").agg(F.get(F.sort_array(F.collect_list("count"), asc=False), F.lit(k - 1)).alias("bar"))
    open_ = materialize(seen.where("bucket is not null").join(bar, "column", "left")
                        .where(F.col("count") >= F.coalesce(F.col("bar"), F.lit(0))).select("column", "bucket"))
    left = {r["column"] for r in open_.select("column").distinct().collect()}
    if left:
        rest = join_small(cells([c for c in cols if c in left]), open_, ["column", "bucket"], materialized=True)
        counts = counts.unionByName(rest.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    w = W.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .withColumn("rank", F.col("rank").cast("long")))


@missing_aware
def group_values(df: DataFrame, group: str) -> DataFrame:
    """Distinct non-null group values, sorted."""
    if group not in df.columns:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(group,
                                                                                T.StringType())]))
    return df.select(group).where(_q(group).isNotNull()).distinct().orderBy(group)


@missing_aware
def group_preview(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Number of groups, the first k (sorted) and how many more.

    The first k come from a distributed top-k; a union with the count and
    one global aggregate over those k+1 rows assembles the answer."""
    ds = df.select(_q(group).alias("g")).where(F.col("g").isNotNull()).distinct()
    first = ds.orderBy("g").limit(k).select("g", F.lit(None).cast("long").alias("n"))
    n = ds.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast(ds.schema["g"].dataType)
                                                   .alias("g"), "n")
    both = first.unionByName(n)
    return both.agg(F.max("n").alias("n_groups"),
                    F.array_sort(F.collect_list("g")).alias("first_groups")) \
               .select("n_groups", "first_groups",
                       F.greatest(F.col("n_groups") - k, F.lit(0)).alias("more"))


def _moments_job(cols: list[str], means: list[float]):
    """Sums of every column pair over the rows where both are present, for a
    whole partition: n, x, y, xx, yy, xy (centred on ``means``)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        k = len(cols)
        total = np.zeros((6, k, k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1) - means
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            with np.errstate(invalid="ignore"):  # infinities make a pair NaN
                total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([cols[a] for a in i]), pa.array([cols[a] for a in j]), *(pa.array(t[i, j]) for t in total)],
            names=["col_x", "col_y", "n", "sx", "sy", "sxx", "syy", "sxy"])
    return run


@missing_aware
def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A20 + C4: Pearson r for every ordered pair of numeric columns
    (pairwise NULL removal), with the 2-decimal heat-map label.

    A first aggregate gives the columns' means; then every task sums the
    centred moments of all pairs over its Arrow batches as matrix products
    and puts out one row per pair, whatever its number of rows.
    """
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_x STRING, col_y STRING, r DOUBLE, r_label DOUBLE")
    ship_package(df.sparkSession)
    x = df.select(*[_q(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    means = [m or 0.0 for m in x.agg(*[F.avg(finite(F.col(c))) for c in x.columns]).first()]
    parts = x.mapInArrow(_moments_job(cols, means), "col_x string, col_y string, n double, sx double, sy double, "
                                                    "sxx double, syy double, sxy double")
    t = parts.groupBy("col_x", "col_y").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    r = t.select("col_x", "col_y", nan_to_null(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias("r"))
    both = F.array(F.struct(F.col("col_x"), F.col("col_y"), F.col("r")),
                   F.struct(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y"),
                            F.col("r")))
    out = r.select(F.inline(F.when(F.col("col_x") == F.col("col_y"), F.slice(both, 1, 1))
                            .otherwise(both)))
    return out.select("col_x", "col_y", "r", F.round("r", 2).alias("r_label"))
