"""Exact quantiles (linear interpolation) at any group size, by one path.

Spark's exact ``percentile`` keeps every distinct value of a group in one
in-memory buffer on one reducer. :func:`stats_with_quantiles` narrows down the
wanted ranks instead:

1. the aggregate that computes the other statistics also gives every key's
   number of values, smallest and largest value: its first interval;
2. while an interval holds more than ``MOVE`` rows, one aggregate counts its
   values in ``BINS`` equal parts, each with its smallest and largest value.
   Running counts say which part holds a wanted rank. A part of one value is
   the answer; the other parts that hold one are the next intervals;
3. the values of the last intervals are counted one by one.

Every pass reads the pruned input and shuffles at most one row per key, part
(or value of a last interval) and task; a value that most rows have is one
row, wherever it falls. What is written is a few rows per key.

The result equals ``percentile`` / pandas ``quantile`` / DuckDB
``quantile_cont``: value(lo) + (h - lo) * (value(lo + 1) - value(lo)),
h = (n - 1) * p; where the fraction is 0 or both values are equal (so also
for equal infinities) it is value(lo) itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from capsight.functions.joins import join_small, materialize

BINS = 4096
MOVE = 1 << 20     # rows of an interval up to which its values are counted one by one
MOST_CUTS = 8      # beyond, the values are counted one by one whatever their number
_ALL = "_q_all"
_INF = float("inf")


def _usable(v: str | Column) -> Column:
    """The value as a double; NaN counts as missing, like NULL."""
    v = (v if isinstance(v, Column) else F.col(v)).cast("double")
    return F.when(~F.isnan(v), v)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] a value falls into: rising with the value. The
    infinities have parts of their own."""
    step = F.when(hi - lo < _INF, (v - lo) / (hi - lo)).otherwise(v / 2 / (hi / 2 - lo / 2) - lo / 2 / (hi / 2 - lo / 2))
    return F.when(v == -_INF, -1).when(v == _INF, BINS).otherwise(F.least(F.floor(step * BINS), F.lit(BINS - 1))).cast("int")


def _located(rows: DataFrame, keys: list[str], iv: DataFrame, probs, single: bool, whole: bool) -> DataFrame:
    """(keys..., _i, _side, _f, _c, _start, _lo, _hi, ...): for every wanted rank
    that lies in an interval of ``iv`` the part (with ``single`` the value) of
    ``rows(keys, _v)`` that holds it. ``iv(keys, _qn, _iv)`` lists the intervals
    of a key; ``whole`` says that each key has one, which holds all its rows."""
    v, zero = F.col("_v"), F.lit(0).cast("long")
    if whole and single:
        cut = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        cut = cut.select(*keys, zero.alias("_start"), "_c", v.alias("_lo"), v.alias("_hi"), v.alias("_flo"), v.alias("_fhi"))
    else:
        names = ("start", "lo", "hi", "flo", "fhi")
        slots = 1 if whole else 2 * len(probs)
        flat = iv.select(*keys, *[F.get("_iv", F.lit(k))[c].alias(f"_{c}{k}") for k in range(slots) for c in names])
        j = join_small(rows, flat, keys, materialized=True)

        def pick(c):
            out = F.lit(None)
            for k in range(slots):
                out = F.when((v >= F.col(f"_lo{k}")) & (v <= F.col(f"_hi{k}")), F.col(f"_{c}{k}")).otherwise(out)
            return out.alias(f"_{c}")

        j = j.select(*keys, "_v", pick("start"), pick("flo"), pick("fhi")).where("_start is not null")
        some = F.col("_flo") < F.col("_fhi")
        part = v if single else _part(v, F.when(some, F.col("_flo")).otherwise(0.0), F.when(some, F.col("_fhi")).otherwise(1.0))
        finite = F.when(F.abs(v) < _INF, v)
        cut = (j.groupBy(*keys, "_start", part.alias("_part"))
               .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                    F.min(finite).alias("_flo"), F.max(finite).alias("_fhi")).drop("_part"))
    upto = W.partitionBy(*keys, "_start").orderBy("_lo").rowsBetween(W.unboundedPreceding, 0)
    counts = join_small(cut, iv.select(*keys, "_qn"), keys, materialized=True)
    counts = counts.withColumn("_end", F.col("_start") + F.sum("_c").over(upto))
    begin = F.col("_end") - F.col("_c")
    h = [(F.col("_qn") - 1) * F.lit(float(p)) for p in probs]
    ranks = [(i, side, r, x - r0) for i, (x, r0) in enumerate((x, F.floor(x).cast("long")) for x in h)
             for side, r in enumerate((r0, F.least(r0 + 1, F.col("_qn") - 1)))]
    hit = F.lit(False)
    for _, _, r, _ in ranks:
        hit = hit | ((r < F.col("_end")) & (r >= begin))
    here = F.filter(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), r.alias("_r"), f.alias("_f"))
                              for i, side, r, f in ranks]), lambda t: (t["_r"] < F.col("_end")) & (t["_r"] >= begin))
    return counts.where(hit).select(*keys, "_qn", "_c", begin.alias("_start"), "_lo", "_hi", "_flo", "_fhi", F.inline(here))


def _select(rows: DataFrame, keys: list[str], first: DataFrame, probs, names) -> DataFrame:
    """(keys..., names...) of ``rows(keys, _v)``; ``first`` is (keys, _qn, _iv)."""
    iv, found, cuts = first, [], 0
    most = first.agg(F.max("_qn")).first()[0] or 0
    while True:
        single = most <= MOVE or cuts == MOST_CUTS
        part = _located(rows, keys, iv, probs, single, whole=not cuts)
        if single:
            found.append(part)
            break
        part = materialize(part)
        cuts += 1
        found.append(part.where("_lo = _hi"))
        open_ = part.where("_lo < _hi")
        most = open_.agg(F.max("_c")).first()[0]
        if not most:
            break
        iv = materialize(open_.groupBy(*keys).agg(F.first("_qn").alias("_qn"), F.collect_set(F.struct(
            F.col("_start").alias("start"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
            F.col("_flo").alias("flo"), F.col("_fhi").alias("fhi"))).alias("_iv")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = out.groupBy(*keys).agg(*[e for i in range(len(probs)) for e in (
        *[F.max(F.when((F.col("_i") == i) & (F.col("_side") == s), F.col("_lo"))).alias(f"_v{i}_{s}") for s in (0, 1)],
        F.max(F.when(F.col("_i") == i, F.col("_f"))).alias(f"_f{i}"))])
    cols = []
    for i, name in enumerate(names):
        f, v0, v1 = (F.col(c) for c in (f"_f{i}", f"_v{i}_0", f"_v{i}_1"))
        cols.append(F.when((f == 0) | (v0 == v1), v0).otherwise(v0 + f * (v1 - v0)).alias(name))
    return out.select(*keys, *cols)


def _interval(v: Column) -> list[Column]:
    """Number of values, range and finite range of ``v``."""
    finite = F.when(F.abs(v) < _INF, v)
    return [F.count(v).alias("_qn"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
            F.min(finite).alias("_flo"), F.max(finite).alias("_fhi")]


def _whole() -> Column:
    return F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                            F.col("_flo").alias("flo"), F.col("_fhi").alias("fhi")))


def stats_with_quantiles(df: DataFrame, keys: list[str], value: str | Column,
                         base: list[Column], probs: list[float], names: list[str]) -> DataFrame:
    """One row per key with the ``base`` aggregates and exact quantiles (NULL
    where a key has no value); the base and the first intervals come from one
    pass."""
    ks = list(keys) or [_ALL]
    v = _usable(value)
    st = df.groupBy(*keys).agg(*base, *_interval(v))
    rows = df
    if not keys:
        st, rows = st.withColumn(_ALL, F.lit(0)), df.withColumn(_ALL, F.lit(0))
    st = materialize(st.withColumn("_iv", _whole()).drop("_lo", "_hi", "_flo", "_fhi"))
    rows = rows.select(*ks, v.alias("_v")).where(F.col("_v").isNotNull())
    q = _select(rows, ks, st.where("_qn > 0").select(*ks, "_qn", "_iv"), probs, names)
    out = st.drop("_qn", "_iv").join(q, ks, "left")
    return out if keys else out.drop(_ALL)


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float],
                    names: list[str]) -> DataFrame:
    """(keys..., one column per name): exact linear-interpolation quantiles of
    the non-NULL values of ``value`` per key."""
    rows = df.select(*[F.col(k) for k in keys], _usable(value).alias("_x")).where(F.col("_x").isNotNull())
    out = stats_with_quantiles(rows, keys, "_x", [F.count(F.lit(1)).alias("_rows")], probs, names)
    return out.where(F.col("_rows") > 0).drop("_rows")


def quantiles_by_column(df: DataFrame, cols: list[str], values: dict[str, Column],
                        probs: list[float], names: list[str]) -> DataFrame:
    """(column, names...): exact quantiles of several columns in one plan, the
    column name acting as the group key. The first intervals of all columns
    come from one wide aggregate."""
    vs = [_usable(values[c]) for c in cols]
    wide = df.agg(*[e.alias(f"c{i}{k}") for i, v in enumerate(vs) for k, e in enumerate(_interval(v))])
    first = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"c{i}{k}").alias(n) for k, n in enumerate(("_qn", "_lo", "_hi", "_flo", "_fhi"))])
        for i, c in enumerate(cols)])))
    first = materialize(first.where("_qn > 0").select("column", "_qn", _whole().alias("_iv")))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("_v")) for c, v in zip(cols, vs, strict=True)])))
    return _select(long.where("_v is not null"), ["column"], first, probs, names)
