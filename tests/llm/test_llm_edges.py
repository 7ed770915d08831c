"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns
with clashing names, for every corpus operator and pipeline stage."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from capsight.llm import (chunk_dedup, html_blocks, minhash_forest, mixing, nn_descent, packing, quality_knn,
                          quality_rules, suffix_dedup, toxicity_cnn)

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PLAIN = "the rain of an autumn and the wind that was in it " * 8
ROWS = [
    (1, PLAIN + "one", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "de", "b", 4),
    (5, "two words", "fr", "b", 9), (None, "no id here at all", "en", "c", 3), (6, LONG, "en", "c", len(LONG)),
    (1, PLAIN + "one", "en", "a", 1), (7, PLAIN + "one", None, "a", 1), (8, "é" * 300, "es", None, 300),
    (None, None, None, None, None),
]
CLASH = ["score", "size", "component_id", "kept", "spans", "n", "node", "copies", "key", "target", "c0", "rid", "s_null"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 0), (3, None, None), (5, 7, 7), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


REPORTS = {
    "op1": lambda d, la: minhash_forest.near_groups(d),
    "op2": lambda d, la: quality_rules.rule_report(d),
    "op3": lambda d, la: chunk_dedup.dedup_report(d),
    "op4": lambda d, la: suffix_dedup.dedup_report(d),
    "op8": lambda d, la: toxicity_cnn.classify(d, la),
    "op9": lambda d, la: mixing.mix_plan(d),
    "op10": lambda d, la: quality_knn.classify(d, la),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_per_row(docs, labels, name):
    out = REPORTS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    twice = [tuple(r) for r in out if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("name", REPORTS)
def test_empty_table(docs, labels, name):
    assert REPORTS[name](docs.limit(0), labels).count() == 0
    assert REPORTS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_near_groups(docs):
    out = {r["doc_id"]: r for r in minhash_forest.near_groups(docs).collect() if r["doc_id"] is not None}
    assert out[2]["n_shingles"] == out[3]["n_shingles"] == out[4]["n_shingles"] == 0
    assert out[5]["n_shingles"] == 1 and out[8]["n_shingles"] == 1 and out[6]["n_shingles"] == 59_998
    assert out[7]["component_id"] == 1 and not out[7]["kept"] and out[1]["kept"]
    assert all(out[i]["component_id"] == i and out[i]["kept"] for i in (2, 3, 4, 5, 6, 8))
    lost = [r for r in minhash_forest.near_groups(docs).collect() if r["doc_id"] is None]
    assert all(r["component_id"] is None and not r["kept"] for r in lost)


def test_rules(docs):
    out = {r["doc_id"]: r for r in quality_rules.rule_report(docs).collect()}
    assert out[2]["n_words"] == out[3]["n_words"] == out[4]["n_words"] == 0 and out[2]["base_failed"]
    assert out[1]["base_failed"] and out[1]["n_repeat_words"] > 80  # the same clause eight times
    assert out[6]["n_words"] == 60_000 and not out[6]["base_failed"] and not out[6]["kept"]  # no stop words


def test_suffix(docs):
    out = {r["doc_id"]: r for r in suffix_dedup.dedup_report(docs).collect()}
    assert out[1]["n_removed"] == out[1]["n_bytes"] == out[7]["n_removed"]
    assert out[8]["n_bytes"] == 600 and out[8]["n_removed"] == 600  # overlapping in itself
    assert out[6]["n_removed"] == out[2]["n_bytes"] == out[3]["n_spans"] == 0
    assert out[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_chunks(docs):
    out = {r["doc_id"]: r for r in chunk_dedup.dedup_report(docs).collect()}
    assert out[7]["n_removed"] > 0.9 * out[7]["n_bytes"] and out[2]["text"] == ""
    assert out[6]["text"] == LONG and out[6]["n_removed"] == 0
    kept = chunk_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_packing(docs):
    out = packing.pack(docs).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 2) == 1  # the end id alone
    assert sum(1 for r in out if r["start"] == 0) == len(ROWS)
    assert packing.pack(docs.limit(0)).count() == 0


def test_scores(docs, labels):
    for out in (toxicity_cnn.classify(docs, labels), quality_knn.classify(docs, labels),
                toxicity_cnn.classify(docs, labels.limit(0)), quality_knn.classify(docs, labels.limit(0))):
        for r in out.collect():
            assert 0 <= r["score"] <= 1 and r["held_out"] in (True, False)
    assert {r["score"] for r in quality_knn.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_mixing(docs, spark):
    out = mixing.mix_plan(docs)
    assert {r["doc_id"]: r["size"] for r in out.collect()}[2] == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.agg(F.sum("copies")).first()[0]
    alone = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix_plan(alone).collect()] == [(1, 0, 0, 0.0, 0, 0)]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pages(spark):
    pages = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>x", "x"), (2, "u", "<p>x", "x"),
             (3, "u", "<article><p>" + "word " * 50_000 + "</p><!-- open", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    out = html_blocks.extract(df).collect()
    assert len(out) == 5 and {r["page_id"]: r["n_chars"] for r in out}[3] == 249_999
    assert all(r["text"] == "" for r in out if r["page_id"] in (1, None))
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 20, [1.0, 0.0, float(i % 3)], "x") for i in range(6)]
    rows += [(7, None, "x"), (140, [0.0, 0.0, 0.0], "x"), (160, [nan, 1.0, 0.0], "x"), (180, [inf, 0.0, 0.0], "x"),
             (200, [1.0, None, 0.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (220, [1.0], "x"), (0, [1.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = rows_of(nn_descent.search(df))
    want = []
    vecs = {i * 20: (1.0, 0.0, float(i % 3)) for i in range(6)}
    for q, x in vecs.items():
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vecs.items() if v != q)
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(near)]
    assert out == sorted(want, key=str)
    assert nn_descent.search(df.limit(0)).count() == 0


def test_stages(docs, labels, tmp_dir):
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    spark = docs.sparkSession
    for table in (docs, docs.limit(0)):
        for name, step in pipeline.STAGES:
            out = step(spark, table, tmp_dir)
            n = out.count()
            assert n == 0 or table.columns
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    kept = pipeline.near_dedup(spark, docs, tmp_dir)
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 2


def test_near_dedup_of_shared_ids(spark, tmp_dir):
    """Different texts under one doc_id, or under none, all stay; of near ones
    the row with the smallest doc_id."""
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdef"]
    rows = [(5, text[0]), (5, text[1]), (5, text[1] + " more"), (None, text[2]), (None, text[3]), (9, text[3] + " end"),
            (2, text[0] + " x"), (7, ""), (7, ""), (7, None), (None, text[4]), (None, text[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash")).repartition(4)
    out = pipeline.near_dedup(spark, df, tmp_dir)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    one = min((text[1], text[1] + " more"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [(2, text[0] + " x"), (5, one), (None, text[2]), (9, text[3] + " end"), (7, ""), (7, ""), (7, None), (None, text[4])]
    assert got == sorted(want, key=str)


def test_quality_stage_leaves_a_score_column_alone(docs, labels, tmp_dir):
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    out = pipeline.quality(docs.sparkSession, docs.withColumn("score", F.lit(0.123)), tmp_dir)
    assert out.columns == docs.columns and {r["score"] for r in out.collect()} <= {0.123}


def test_mixing_of_rows_without_ids(spark):
    """Texts under a null or one repeated doc_id draw on their own."""
    rows = [(None, f"word{i} a b c", "x") for i in range(2000)] + [(3, f"word{i} d e f", "y") for i in range(2000)]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1))
    for r in out.groupBy("source_size", "target", "doc_id").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.1


def test_walk_batches_are_bounded(spark):
    """Long rows reach Python in batches of few, and the settings return."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda: [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()]
    whole = sizes()
    with nn_descent.small_batches(spark, nn_descent.BATCH_MB * 10_000):
        assert max(sizes()) <= 100
    assert spark.conf.get(name) == before and sizes() == whole
    b = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    cut = list(nn_descent._pieces([b], nn_descent.PIVOT_CELLS // 300))
    assert max(c.num_rows for c in cut) <= 301 and pa.Table.from_batches(cut)["x"].to_pylist() == list(range(1000))
