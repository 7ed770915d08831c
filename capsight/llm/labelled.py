"""Labelled rows for the text classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.common import semi_by_id


def fold(doc_id):
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id):
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, extra=()) -> DataFrame:
    """At most ``bound`` rows (doc_id, label, text, *extra) of ``docs`` with a
    0/1 label outside the held-out fold: those of the labelled ids that come
    first by a hash of the id. A repeated id counts once."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .filter("doc_id is not null and label in (0, 1)").filter(fold(F.col("doc_id")) != 1)
           .groupBy("doc_id").agg(F.min("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c).cast("string").alias(c) for c in extra])
    return semi_by_id(rows, ids.select("doc_id")).dropDuplicates(["doc_id"]).join(F.broadcast(ids), "doc_id")
