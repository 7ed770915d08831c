"""Row filters.

Predicates are bare comparisons on the stored column, with a NaN test beside
them where one is needed, so Catalyst pushes them into the parquet scan
(``PushedFilters``); NaN becomes NULL in what leaves the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.missing import is_float, missing_aware, nan_as_missing

OPERATORS = ("equals", ">", "<", "contains")


def _check(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found; available: {', '.join(df.columns)}")


def filter_group(df: DataFrame, group: str, value) -> DataFrame:
    """P10: rows of one group."""
    _check(df, group)
    return nan_as_missing(df.where(F.col(group) == F.lit(value)))


def _plain_text(c: Column) -> Column:
    """Text of a double in plain decimals from 1e-4 up to 1e16 (12345678.0,
    not 1.2345678E7), as the reference prints it."""
    s = c.cast("string")
    digits = F.rtrim(s.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(s, F.lit("E")) & (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain).otherwise(s)


def predicate(df: DataFrame, column: str, operator: str, value: str) -> Column:
    """P11-P14 as a column expression.

    ``equals`` compares with the value cast to the column's type (a numeric
    column matches ``"5"``); ``>`` and ``<`` compare as doubles; ``contains``
    is a case-insensitive Java regular-expression search over the text form
    of any type (doubles in plain decimals). NULL and NaN never match.
    """
    _check(df, column)
    c = F.col(f"`{column}`")
    t = df.schema[column].dataType
    if operator == "equals":
        lit = F.lit(value) if isinstance(t, T.StringType) else F.lit(value).try_cast(t)
        p = c == lit
    elif operator in (">", "<"):
        if not isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"operator {operator!r} needs a numeric column; {column!r} is "
                             f"{t.simpleString()}")
        lit = F.lit(float(value)) if isinstance(t, T.NumericType) else F.lit(value).try_cast(t)
        p = (c > lit) if operator == ">" else (c < lit)
    elif operator == "contains":
        text = _plain_text(c) if is_float(t) else c.cast("string")
        p = text.rlike("(?i)" + value)
    else:
        raise ValueError(f"invalid operator {operator!r}; use one of {', '.join(OPERATORS)}")
    # NaN sorts above every number, so that < leaves it out by itself
    return p & ~F.isnan(c) if is_float(t) and operator != "<" else p


def filter_data(df: DataFrame, column: str, operator: str, value: str) -> DataFrame:
    return nan_as_missing(df.where(predicate(df, column, operator, value)))


def filter_summary(df: DataFrame, column: str, operator: str, value: str) -> DataFrame:
    """Matching rows, all rows and the match share in percent (one pass)."""
    p = predicate(df, column, operator, value)
    return df.agg(F.count_if(p).alias("matches"), F.count(F.lit(1)).alias("rows")) \
             .withColumn("match_pct",
                         F.try_divide(F.col("matches") * 100.0, F.col("rows")))


def filter_sample(df: DataFrame, column: str, operator: str, value: str,
                  order: list[str], k: int = 5) -> DataFrame:
    """L4: the first k matching rows in ``order`` (a distributed top-k)."""
    return filter_data(df, column, operator, value).orderBy(*order).limit(k)


@missing_aware
def head(df: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """L1: first k rows, made deterministic by an explicit order."""
    return df.orderBy(*order).limit(k)
