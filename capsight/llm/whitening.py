"""Whitening of embeddings with distributed block matrices.

Every entry c becomes the integer x = floor(64 c) + 1000000. Rows get a dense
index; the centred rows form a ``BlockMatrix`` of tall blocks. Its transpose
times itself is the scatter matrix (the product is split along the rows, so its
work spreads over the cluster and only d x d matrices are added up), whose
eigenvectors, scaled by 1 / sqrt(eigenvalue), are the whitening matrix; a second
block product projects all rows. Only d x d numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.common import drop_staged, ship, stage

COMPONENTS = 32
BLOCK_VALUES = 1 << 19  # values of a block: 4 MB
BLOCKS_A_SPLIT = 8      # row blocks multiplied by one task
LARGEST = float(1 << 50)  # entries from here on have no exact 64-bit x


def integer_rows(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of ``table(vec_id, embedding)``."""
    e = F.col("embedding")
    return (table.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
            .filter("embedding is not null and size(embedding) > 0")
            .filter(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
            .select("vec_id", F.transform(e, lambda c: F.floor(c * 64).cast("long") + 1000000).alias("x")))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` written once, with a dense ``index`` from 0: place in its part
    plus the rows of the parts before, both read off the written table."""
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("rid", 33)
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")  # a row a task
    return (rows.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("index", F.col("before") + F.col("rid") - F.shiftleft("part", 33)).drop("part", "before", "rid"))


def scatter(m: BlockMatrix) -> np.ndarray:
    """m' m, the product split along the rows of ``m``."""
    splits = max(1, -(-m.numRowBlocks // BLOCKS_A_SPLIT))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    out = BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def _gram_job(mean):
    """Sums of the outer products of a task's centred whitened rows."""
    def run(batches):
        k = len(mean)
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = b.column("y").flatten().to_numpy().reshape(b.num_rows, k) - mean
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)),
                                          pa.array(total.ravel())], names=["i", "j", "s"])
    return run


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``white(y)`` minus the identity."""
    sums = white.agg(*[F.sum(F.col("y")[i]) for i in range(k)]).first()
    mean = np.array(sums, float) / n
    got = white.select("y").mapInArrow(_gram_job(mean), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    cov = np.zeros((k, k))
    for r in got.collect():
        cov[r["i"], r["j"]] = r["s"] / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """(rows, model): vec_id, deviation (decimal(38,0): the sum over dimensions
    of (n x - S)^2) and y (the whitened components) of every usable row of
    ``table(vec_id, embedding)``; the model holds n, explained, mean, matrix
    and identity_error.

    Rows whose vector is null, empty, holds null or non-finite entries or
    entries of 2^50 or more (whose x no long holds exactly) take no part. A
    covariance needs one length: that of most rows is taken (the shorter, if
    as frequent) and rows of another length take no part. Rows that repeat a
    vec_id count each; a null vec_id stays null. A direction without variance
    (eigenvalue not above rounding) has no whitened value: its components are
    null and not part of identity_error. Other columns are ignored; a table
    without usable rows gives no rows.
    """
    spark = table.sparkSession
    ship(spark)
    rows = integer_rows(table)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return (spark.createDataFrame([], "vec_id long, deviation decimal(38,0), y array<double>"),
                {"n": 0, "explained": [], "identity_error": 0.0})
    d, n = common["d"], common["count"]
    k = min(components, d)
    rows = indexed(rows.filter(F.size("x") == d))
    sums = [int(s) for s in rows.agg(*[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d)]).first()]
    # n x - S in whole numbers before the division: centred without rounding errors
    total = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    moved = F.zip_with("x", total, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - s).cast("decimal(38,0)"))
    rows = rows.withColumn("m", moved)
    per_block = max(1, BLOCK_VALUES // d)
    vectors = rows.select("index", array_to_vector(F.transform("m", lambda v: v.cast("double") / n)).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    centred = IndexedRowMatrix(vectors, n, d).toBlockMatrix(per_block, d)
    v = scatter(centred) / n
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[:k]
    value, vector = value[order], vector[:, order]
    trace = float(np.trace(v))
    sound = value > max(trace, 0.0) * d * np.finfo(float).eps
    matrix = np.where(sound, vector / np.sqrt(np.where(sound, value, 1.0)), 0.0)
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel("F")))], 1)
    projected = centred.multiply(BlockMatrix(local, d, k)).toIndexedRowMatrix()
    white = (callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
             .select("index", vector_to_array("vector").alias("y")))
    square = F.aggregate("m", F.lit(0).cast("decimal(38,0)"), lambda a, m: (a + m * m).cast("decimal(38,0)"))
    done = stage(rows.select("index", "vec_id", square.alias("deviation")).join(white, "index")
                 .select("vec_id", "deviation", "y"), "white")
    drop_staged(spark, rows)
    kept = int(sound.sum())
    error = identity_error(done, n, kept) if kept == k else identity_error(
        done.select(F.slice("y", 1, kept).alias("y")), n, kept) if kept else 0.0
    if kept < k:
        done = done.withColumn("y", F.transform("y", lambda x, i: F.when(i < kept, x)))
    return done, {"n": n, "explained": [float(x) / trace if trace > 0 else 0.0 for x in np.maximum(value, 0)],
                  "identity_error": error, "matrix": matrix, "mean": [s / n for s in sums]}


def report(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component (from 1), n,
    deviation (null where no 64-bit number holds it), whitened, explained and
    identity_error. See :func:`whiten` for the rows that take part."""
    rows, model = whiten(table, components)
    shares = F.array(*[F.lit(x) for x in model["explained"]]) if model["explained"] else F.array().cast("array<double>")
    return (rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"),
                        F.posexplode(F.arrays_zip("y", shares.alias("s"))).alias("p", "c"))
            .select("vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"),
                    "deviation", F.col("c.y").alias("whitened"), F.col("c.s").alias("explained"),
                    F.lit(model["identity_error"]).alias("identity_error")))
