"""Registry plumbing for the query catalog.

Each registered query pairs a Spark plan over the given tables with an
equivalent DuckDB SQL text (the oracle). Doubles are rounded to a fixed
number of decimals on both sides, so that summation order cannot change
the compared value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from capsight.sources import tables


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` of the SQL as ``(round(...) + 0.0)``.

    Rounding a small negative number to zero gives -0.0 in DuckDB but 0.0 in
    Spark (which rounds through a decimal); adding 0.0 turns -0.0 into 0.0
    and leaves every other value unchanged, so both sides print the same.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def register(key: str, sql: str | None, views: tuple[str, ...] = ("visits",), note: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        text = positive_zero_rounds(tables.with_views(sql, *views)) if sql else None
        REGISTRY[key] = Query(key, fn, text, note)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns; every other column keeps its type (the oracle
    returns the same types: counts BIGINT, source INTEGER columns INTEGER)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def view(spark: SparkSession, sf_dir: str, name: str = "visits") -> DataFrame:
    return tables.VIEW_FRAMES[name](spark, sf_dir)


def roles_of(name: str = "visits"):
    return tables.VIEW_ROLES[name]


# SQL fragment: row utilization in percent, same rule as
# capsight.functions.exprs.utilization_pct.
def util_sql(a: str = "attendees", c: str = "capacity") -> str:
    return (f"(CASE WHEN {a} IS NULL OR {c} IS NULL THEN 0.0 "
            f"WHEN {c} <> 0 THEN {a} / {c} * 100 "
            f"WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE ELSE 0.0 END)")


def nn(expr: str) -> str:
    """NaN -> NULL in SQL."""
    return f"(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END)"
