"""A corpus cleaning pipeline over ``documents``: each stage applies one of the
corpus operators to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions.joins import join_small
from capsight.llm import chunk_dedup, minhash_forest, mixing, packing, quality_knn
from capsight.llm.common import free_name, semi_by_id, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality_knn.score(docs, model, score).filter(F.col(score) >= 0.5).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles,
    similarity 0.8 or more): the one with the smallest doc_id (null last), of
    several under it the one with the smallest digest of its text. Rows are
    grouped by their texts, so different texts under one doc_id, or under
    none, are judged apart; a text without words is in no group."""
    rid = free_name(docs, "rid")
    rows = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "near")
    groups = minhash_forest.near_groups(rows.select(F.col(rid).alias("doc_id"), "text"), shingle=5, num=80, den=100)
    linked = stage(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(rid), "component_id"), "linked")
    members = linked.union(linked.select("component_id", F.col("component_id").alias("c")).distinct())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.col("text").cast("string")), rid)
    best = (rows.select(rid, order.alias("o")).join(members, rid)
            .groupBy("component_id").agg(F.min("o").getField(rid).alias("best")))
    lost = stage(join_small(members, best, "component_id").filter(F.col(rid) != F.col("best")).select(rid), "lost")
    return semi_by_id(rows, lost, rid, "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; a document of which nothing is left goes.
    n_chars follows the text."""
    cut = chunk_dedup.dedup(docs).filter("text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as its source's target asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # a classifier, chunk cuts and tokens have no SQL form; tests/llm holds a brute-force run


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the
    shared checkpoint folder and read back as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
