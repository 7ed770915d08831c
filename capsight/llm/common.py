"""Staging and graph helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.session import scratch_dir
from capsight.session import ship_package as ship


def stage(df: DataFrame, name: str, schema=None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: computed once, lineage cut, safe when an executor is lost."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if path.getName().startswith("capsight-"):
                path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as make it new among df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, key: str):
    """Tables of whole groups from batches in ascending order of ``key``."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


BROADCAST_IDS = 2_000_000  # 64-bit ids: at most 16 MB of values


def semi_by_id(df: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one 64-bit column ``key``,
    distinct), or with ``left_anti`` those whose key is not. The ids are counted: up to BROADCAST_IDS they are broadcast,
    beyond that both sides are shuffled."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(side, key, how)


EDGE_BLOCK = 200_000  # edges a task joins on its own (a few MB)


def _forest_job(batches):
    """The components of a block of edges as edges to their smallest nodes."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    out = [(x, find(x)) for x in list(root)]
    out = [(x, r) for x, r in out if x != r]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def components(edges: DataFrame, block: int = EDGE_BLOCK) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root), root being the
    smallest node of the component; nodes without an edge are not returned.

    Tasks first join the edges of a block of their own, which leaves one edge
    per node and block; what is in one block is then done. Alternating
    large-star and small-star steps join the blocks. Every step is a grouped
    minimum (partial aggregation, so a hub costs one row per task) and a join
    that Spark can split on a hot hub; nothing is gathered on the driver but
    two numbers a round, used to see that nothing changed.
    """
    spark = edges.sparkSession
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .filter("u <> v").distinct(), "edges")

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    ship(spark)
    blocks = -(-before[0] // block)
    forest = stage(e.coalesce(blocks).mapInArrow(_forest_job, "u long, v long"), "edges")
    if blocks == 1:
        return forest.select(F.col("u").alias("node"), F.col("v").alias("root"))
    drop_staged(spark, e)
    e, before = forest, (0, 0)
    while True:  # every round lowers some root, so the rounds end
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        nxt = stage(nxt, "edges")
        now = mark(nxt)
        drop_staged(spark, e)
        e = nxt
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def merge_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp(node, root)`` after adding ``edges(a, b)``: only the roots at the
    edges' ends are worked on again."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    of = stage(ends.join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "ends")
    between = (edges.join(of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
               .join(of.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
               .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    # the members of a moved component, and ends that had none so far
    known = comp.select("node", "root").union(of.select("node", "root")).union(
        of.select(F.col("root").alias("node"), "root")).distinct()
    return (known.join(moved, known.root == moved.old, "left")
            .select("node", F.coalesce("new", "root").alias("root")).filter("node <> root"))
