"""Joining a small per-group table back onto rows, with a checked broadcast.

Statistics computed per group (one row per group, or per group and bucket)
are joined back to the rows they came from. Broadcasting them avoids any
shuffle of the rows, but only a table whose size is known to be small may
be broadcast. :func:`join_small` therefore writes the small side to the
shared checkpoint folder (``checkpoint()``, which also cuts its lineage so
it is computed once), measures it, and broadcasts it only under
``BROADCAST_MAX_BYTES``; beyond that it leaves a plain join, which Spark
plans as a shuffled join with AQE splitting skewed partitions.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.session import ensure_checkpoint_dir, scratch_dir

BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def _value_bytes(c: Column, t: T.DataType) -> Column:
    """Bytes one value takes, measured: text and binary by their length,
    arrays and maps by their elements, the rest by the type's width."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
    if isinstance(t, T.ArrayType):
        fixed = not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        total = F.size(c).cast("long") * 8 if fixed else F.aggregate(
            c, F.lit(0).cast("long"), lambda acc, x: acc + _value_bytes(x, t.elementType))
        return F.coalesce(total, F.lit(0)) + 16
    if isinstance(t, T.MapType):
        return _value_bytes(F.map_keys(c), T.ArrayType(t.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(t.valueType))
    if isinstance(t, T.StructType):
        total = F.lit(8).cast("long")
        for f in t.fields:
            total = total + _value_bytes(c[f.name], f.dataType)
        return total
    return F.lit(16 if isinstance(t, T.DecimalType) else 8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, with 16 for the row."""
    row = F.lit(16).cast("long")
    for f in df.schema.fields:
        row = row + _value_bytes(F.col(f"`{f.name}`"), f.dataType)
    return row


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df`` (one aggregate), with 16 a row."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


_REUSE: dict | None = None


@contextmanager
def reuse_materialized():
    """Within the block, materializing the same plan twice returns the first
    copy (for jobs that build several families over one input). Outside a
    block nothing is remembered, so a later call never sees stale data."""
    global _REUSE
    outer = _REUSE
    _REUSE = {} if outer is None else outer
    try:
        yield
    finally:
        _REUSE = outer


def materialize(df: DataFrame) -> DataFrame:
    """Write a (small) table to the shared checkpoint folder and read it back."""
    known = None
    if _REUSE is not None:
        known = _REUSE.setdefault(df.semanticHash(), [])
        for source, copy in known:
            if df.sameSemantics(source):  # the hash alone may collide
                return copy
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if known is not None:
        known.append((df, out))
    return out


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES, materialized: bool = False) -> DataFrame:
    """``big.join(small, on, how)``, broadcasting ``small`` only when its
    measured size is under ``max_bytes`` (pass ``materialized=True`` when
    ``small`` was already checkpointed)."""
    if not materialized:
        small = materialize(small)
    side = F.broadcast(small) if measured_bytes(small) <= max_bytes else small
    return big.join(side, on, how)


_STAGED: list[tuple] | None = None


@contextmanager
def staging():
    """Within the block staged tables are noted, and removed at its end (for
    jobs that write all their results inside)."""
    global _STAGED
    outer, _STAGED = _STAGED, []
    try:
        yield
    finally:
        for spark, path in _STAGED:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _STAGED = outer


def stage(df: DataFrame, cols: list[str], prefix: str = "stage") -> DataFrame:
    """Write the columns a multi-pass job needs as a Parquet table in the
    shared checkpoint folder and read it back.

    Jobs that run many aggregates over the same derived input (a join, a
    parsed CSV) then read a columnar, splittable table instead of deriving
    it again for every pass; the written table also cuts the lineage, so a
    lost executor never recomputes the derivation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, prefix)
    df.select(*cols).write.mode("overwrite").parquet(path)
    if _STAGED is not None:
        _STAGED.append((spark, path))
    return spark.read.parquet(path)
