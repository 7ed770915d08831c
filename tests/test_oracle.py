"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from capsight.plans import catalog
from oracle_check import compare, duck

from conftest import SMALL

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    if key not in SQL:
        assert df.count() >= 0
        return
    ok, detail = compare(df, con, SQL[key], types=True)
    assert ok, detail


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"building", "day", "occupied_pct", "trend", "zone"} <= set(df.columns)


def test_every_oracle_key_is_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
