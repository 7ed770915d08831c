"""One notion of missing: NaN in a float column (as pandas writes a missing
number) counts as NULL.

The sources hand out the stored columns as they are, so that a comparison on
one reaches the Parquet scan; the operators read their input through
:func:`nan_as_missing` (the decorator :func:`missing_aware`).
"""

from __future__ import annotations

import functools
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def nan_as_missing(df: DataFrame) -> DataFrame:
    """``df`` with NaN in float columns as NULL."""
    return df.withColumns({f.name: F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType))
                           for f in df.schema.fields if is_float(f.dataType)})


_INSIDE: ContextVar[bool] = ContextVar("inside", default=False)


def missing_aware(operator):
    """An operator whose first argument is read with NaN as NULL (once, when
    operators call each other)."""
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kw):
        if _INSIDE.get():
            return operator(df, *args, **kw)
        token = _INSIDE.set(True)
        try:
            return operator(nan_as_missing(df), *args, **kw)
        finally:
            _INSIDE.reset(token)
    return run
