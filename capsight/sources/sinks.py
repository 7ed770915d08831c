"""Sinks (S7, S8): the summary as one table, and one folder per group.

Both write through Spark's writers, so every executor writes its own
partitions; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.joins import join_small, materialize, row_bytes

# Bytes of values that one file of a group takes (see write_by_group).
FILE_BYTES = 256 * 1024 * 1024


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The table with a header row and no index column (CSV or Parquet).

    Excel output is not built; the CSV opens in any spreadsheet tool.
    """
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; use csv or parquet")


def group_slug(group_col: str):
    """File-name form of a group value: spaces -> underscores."""
    return F.replace(F.col(group_col).cast("string"), F.lit(" "), F.lit("_"))


def _plan_tasks(out: DataFrame, file_bytes: int) -> tuple[DataFrame, int]:
    """(slug key, pieces) of the groups larger than a file, and the number of
    writing tasks: one a piece, and as many for all other groups as their
    bytes fill."""
    size = out.groupBy("_slug").agg(F.sum(row_bytes(out.drop("_slug"))).alias("bytes"))
    pieces = F.ceil(F.col("bytes") / F.lit(file_bytes)).cast("int")
    size = materialize(size.select("_slug", "bytes", pieces.alias("_pieces")))
    hot = F.col("_pieces") > 1
    n = size.agg(F.sum(F.when(hot, F.col("_pieces"))).alias("hot"),
                 F.sum(F.when(~hot, F.col("bytes"))).alias("rest")).first()
    return size.where(hot).select("_slug", "_pieces"), (n["hot"] or 0) + max(1, -(-(n["rest"] or 0) // file_bytes))


def write_by_group(df: DataFrame, path: str, group_col: str, fmt: str = "parquet", file_bytes: int = FILE_BYTES) -> None:
    """One folder per group (``group_slug=<value>``); a later read of one
    group prunes to its folder. Rows without a group go to Spark's default one.

    A first aggregate measures every group's bytes. A group of more than
    ``file_bytes`` is split over as many tasks as it fills files (its rows by
    their hash, with the number of the task that read them, so that equal rows
    part too); all other groups are gathered by the hash of their name into
    tasks of about that size. The input is read twice: stage a costly one.
    """
    slug = group_slug(group_col)
    out = df.withColumns({"group_slug": slug, "_slug": F.coalesce(slug, F.lit(""))})
    hot, tasks = _plan_tasks(out, file_bytes)
    values = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = out.withColumn("_spread", F.xxhash64(*values, F.spark_partition_id()))
    placed = join_small(out, hot, "_slug", "left")
    where = F.when(F.col("_pieces").isNull(), F.pmod(F.xxhash64("_slug"), F.lit(tasks)))
    piece = F.pmod(F.col("_spread"), F.col("_pieces"))
    w = (placed.repartition(tasks, where, F.when(F.col("_pieces").isNotNull(), F.col("_slug")), piece)
         .drop("_slug", "_pieces", "_spread").write.mode("overwrite").partitionBy("group_slug"))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
