"""Plan checks: no Python in any registered plan, no cartesian products,
filters pushed into the scan, scans pruned to the columns used."""

import contextlib
import io

import pytest

from capsight.plans import catalog
from conftest import SMALL

QUERIES = catalog.queries()
# Queries that write their input first (ingestion, sinks) are left out of
# the plan sweep; their parts are covered by the ingestion tests.
WRITES = {k for k, f in QUERIES.items() if f.__module__.endswith("q_ingest")}


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITES))
def test_no_python_and_no_product(spark, key):
    p = plan(QUERIES[key](spark, SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{key}: {bad}"


def test_filter_reaches_the_scan(spark):
    p = plan(QUERIES["filter_group"](spark, SMALL))
    assert "EqualTo(p_brand,Brand#13)" in p


def test_flagship_prunes_columns(spark):
    p = plan(QUERIES["daily_utilization"](spark, SMALL))
    scans = [ln for ln in p.splitlines() if "ReadSchema" in ln]
    assert scans and not any("l_extendedprice" in s or "l_comment" in s for s in scans)
    assert "Window" in p and "HashAggregate" in p


def test_flagship_plan_shape(spark):
    """Daily utilization: lineitem read with only the 3 columns it needs,
    partial aggregation before the (group, day) shuffle, one more shuffle
    over the small daily series, and no join that shuffles the rows."""
    p = plan(QUERIES["daily_utilization"](spark, SMALL))
    head = p.split("\n\n")[0]
    li = [ln for ln in p.splitlines() if "ReadSchema" in ln and "l_shipdate" in ln]
    assert li and li[0].count(":") - 1 == 3, li           # struct<a:..,b:..,c:..>
    shuffles = head.count("Exchange (") - head.count("BroadcastExchange (")
    assert shuffles == 2
    assert "SortMergeJoin" not in head and "ShuffledHashJoin" not in head
    lines = head.splitlines()
    deepest = max(i for i, ln in enumerate(lines)
                  if "Exchange (" in ln and "BroadcastExchange" not in ln)
    assert any("HashAggregate" in ln for ln in lines[deepest:])   # partial aggregate below


def test_top_values_uses_group_limit(spark):
    p = plan(QUERIES["top_values"](spark, SMALL))
    assert p.count("WindowGroupLimit") >= 2                # partial + final


def test_trends_move_the_rows_once(spark):
    head = plan(QUERIES["trend_regression"](spark, SMALL)).split("\n\n")[0]
    assert "Window" not in head and "SortMergeJoin" not in head and "ShuffledHashJoin" not in head
    # the rows by range, then pieces by (partition, group), then by group
    assert head.count("Exchange (") - head.count("BroadcastExchange (") == 3


def pushed(df):
    return " ".join(ln for ln in plan(df).splitlines() if "PushedFilters" in ln)


def test_comparisons_reach_the_scan(spark):
    from capsight.operators import filters as fl
    from capsight.sources.tables import read_table
    assert "EqualTo(l_quantity,5.0)" in pushed(QUERIES["filter_equals"](spark, SMALL))
    assert "LessThan(p_size,3)" in pushed(QUERIES["filter_lt"](spark, SMALL))
    items = read_table(spark, SMALL, "lineitem")
    assert "GreaterThan(l_quantity,45.0)" in pushed(items.where("l_quantity > 45"))
    assert "GreaterThan(l_quantity,45.0)" in pushed(fl.filter_data(items, "l_quantity", ">", "45"))
    assert "LessThan(l_quantity,3.0)" in pushed(fl.filter_data(items, "l_quantity", "<", "3"))


def test_nan_rows_stay_missing_behind_filters(spark):
    from capsight.operators import filters as fl
    nan = float("nan")
    df = spark.createDataFrame([(1, 5.0, nan), (2, nan, 1.0), (3, 50.0, 2.0), (4, None, nan)], "k int, x double, y double")
    got = {op: sorted(tuple(r) for r in fl.filter_data(df, "x", op, v).collect())
           for op, v in ((">", "4"), ("<", "60"), ("equals", "nan"), ("contains", "n|5"))}
    both = [(1, 5.0, None), (3, 50.0, 2.0)]
    assert got == {">": both, "<": both, "equals": [], "contains": both}
    assert fl.filter_summary(df, "x", ">", "4").first().matches == 2
