"""Checked broadcast of small per-group tables, and input staging."""

import contextlib
import io

from capsight.functions import joins


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_small_side_is_broadcast_only_under_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # no size-based choice
    try:
        big = spark.range(100_000).selectExpr("id % 10 AS g", "id AS v")
        small = big.groupBy("g").count()
        p_yes = plan(joins.join_small(big, small, "g"))
        p_no = plan(joins.join_small(big, small, "g", max_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p_yes
    assert "BroadcastHashJoin" not in p_no and "SortMergeJoin" in p_no
    assert joins.join_small(big, small, "g").count() == 100_000


def test_stage_writes_and_reads_back(spark):
    df = spark.range(1000).selectExpr("id", "id * 2 AS twice", "'x' AS unused")
    staged = joins.stage(df, ["id", "twice"])
    assert staged.columns == ["id", "twice"]
    assert staged.agg({"twice": "sum"}).first()[0] == 999 * 1000
    assert "FileScan parquet" in plan(staged) or "Scan parquet" in plan(staged)


def test_size_is_measured_not_assumed(spark):
    small = spark.range(3).selectExpr("id AS g", "repeat('x', 1000) AS s", "array('a', repeat('y', 500)) AS a")
    assert 3 * 1500 < joins.measured_bytes(small) < 3 * 1800
    big = spark.range(100).selectExpr("id % 3 AS g")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(joins.join_small(big, small, "g", max_bytes=4000))
        assert "BroadcastHashJoin" in plan(joins.join_small(big, small, "g", max_bytes=8000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reuse_compares_plans_not_only_their_hash(spark, monkeypatch):
    a, b = spark.range(3), spark.range(5)
    monkeypatch.setattr(type(a), "semanticHash", lambda self: 1)
    with joins.reuse_materialized():
        assert joins.materialize(a).count() == 3
        assert joins.materialize(b).count() == 5
        assert joins.materialize(spark.range(3)).count() == 3


def test_staging_removes_its_folders(spark):
    with joins.staging():
        staged = joins.stage(spark.range(5), ["id"])
        path = staged.inputFiles()[0]
        assert staged.count() == 5
    import os
    assert not os.path.exists(path.replace("file://", ""))
