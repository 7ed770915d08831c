"""Scalar column expressions shared by the operators.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
no Python UDF is used anywhere in the package.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
# Missing-value tokens a pandas CSV reader turns into NaN by default:
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Utilization thresholds, in percent of capacity:
LOW_PCT, OPTIMAL_PCT, FULL_PCT = 50.0, 80.0, 100.0
# Histogram bin count and KDE grid size used by the charts:
HIST_BINS, KDE_POINTS = 30, 1000
# ---------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """``df.withColumns(exprs)``, every expression computed once a row whatever
    is built on the result. A filter on a plain projection is moved below it
    with the whole expression in place of the column, so a chain of steps
    computes the first ones again for each later one; a filter on the fields of
    an exploded one-row array stays above."""
    if not exprs:
        return df
    rest = [F.col(f"`{c}`") for c in df.columns if c not in exprs]
    row = F.struct(*[e.alias(c) for c, e in exprs.items()])
    names = df.columns + [c for c in exprs if c not in df.columns]
    return df.select(*rest, F.inline(F.array(row))).select(*[F.col(f"`{c}`") for c in names])


def nan_to_null(c) -> Column:
    """Statistics emit NULL, never NaN."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def utilization_pct(attendees, capacity) -> Column:
    """Row utilization, percent: attendees / capacity * 100.

    NULL on either side -> 0, 0/0 -> 0, x/0 -> +-infinity (what a float
    division followed by "fill missing with 0" gives). The NULL test comes
    first so a NULL capacity never reaches the infinity branches; the
    division only runs for a non-zero divisor (plain ``/`` raises under ANSI).
    """
    a, c = col(attendees).cast("double"), col(capacity).cast("double")
    return (F.when(a.isNull() | c.isNull(), F.lit(0.0))
             .when(c != 0, F.try_divide(a, c) * F.lit(100.0))
             .when(a > 0, F.lit(INF))
             .when(a < 0, F.lit(-INF))
             .otherwise(F.lit(0.0)))


def ratio_pct(num, den) -> Column:
    """Same rule as :func:`utilization_pct`, for two already-aggregated sums."""
    return utilization_pct(num, den)


def bias_corrected_skew(skew_pop: Column, n: Column, std: Column) -> Column:
    """Sample skewness G1 from Spark's population skewness g1.

    G1 = g1 * sqrt(n(n-1)) / (n-2); undefined (NULL) for n < 3; a constant
    column has skewness 0.
    """
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(std == 0, F.lit(0.0))
             .otherwise(skew_pop * F.sqrt(n * (n - 1)) / (n - 2)))


def skew_class(skew) -> Column:
    s = col(skew)
    return (F.when(s > 1, "right").when(s < -1, "left").otherwise("symmetric"))


def direction(slope) -> Column:
    s = col(slope)
    return (F.when(s.isNull(), "unknown").when(s > 0, "up")
             .when(s < 0, "down").otherwise("stable"))


def strength_r2(r2) -> Column:
    """Trend strength on R^2 (row trends): > 0.7 strong, > 0.3 moderate."""
    r = col(r2)
    return F.when(r > 0.7, "strong").when(r > 0.3, "moderate").otherwise("weak")


def strength_abs_r(r) -> Column:
    """Trend strength on |r| (daily utilization trend): > 0.7, > 0.4."""
    a = F.abs(col(r))
    return F.when(a > 0.7, "strong").when(a > 0.4, "moderate").otherwise("weak")


def util_class(u) -> Column:
    """Bar colour of a utilization value: < 50 red, < 80 orange, else green."""
    u = col(u)
    return F.when(u < LOW_PCT, "red").when(u < OPTIMAL_PCT, "orange").otherwise("green")


def zone4(u) -> Column:
    """Daily zone: < 50 critical, [50,80) moderate, [80,100] optimal, > 100 over."""
    u = col(u)
    return (F.when(u < LOW_PCT, "critical").when(u < OPTIMAL_PCT, "moderate")
             .when(u <= FULL_PCT, "optimal").when(u > FULL_PCT, "over"))


# Text a numeric parser takes for a number: optional sign, decimal digits with
# an optional exponent, or inf / infinity in any case; blanks around.
# Possessive, as no shorter match of a part lets a later one fit.
NUMERIC_TEXT = r"^\s*+[+-]?+(?:(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+|(?i:inf|infinity))\s*+$"
INTEGER_TEXT = r"^\s*+[+-]?+\d++\s*+$"


def coerce_numeric(c) -> Column:
    """Text -> double with pandas ``to_numeric(errors='coerce')`` semantics.

    ``' 12 '`` -> 12, ``'1,234'`` -> NULL, ``'inf'`` -> inf, ``'nan'`` -> NULL,
    ``'1d'`` -> NULL. Only text matching :data:`NUMERIC_TEXT` reaches the
    cast: Spark's cast would also take a ``d``/``f`` type suffix, and a
    failing cast per row is far slower than the pattern test.
    """
    s = col(c).cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


# Date formats tried by :func:`choose_date_format`, most specific first.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "M/d/yyyy H:mm", "M/d/yyyy", "d/M/yyyy H:mm", "d/M/yyyy",
    "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "MMM d, yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "d MMMM yyyy",
]


# What a field of a date format can start to be read from (never less).
_FIELDS = {"yyyy": r"[-+]?\d{4,19}", "MMMM": r"\D+", "MMM": r"\D+", "MM": r"\d\d", "dd": r"\d\d", "HH": r"\d\d",
           "mm": r"\d\d", "ss": r"\d\d", "M": r"[-+]?0*([1-9]|1[0-2])", "d": r"[-+]?0*([1-9]|[12]\d|3[01])",
           "H": r"[-+]?\d{1,19}", "'T'": "[Tt]"}
_FIELD = re.compile("|".join(sorted(_FIELDS, key=len, reverse=True)))


def date_shape(fmt: str) -> str:
    """Pattern that every text of the format matches."""
    out, at = r"^\s*", 0
    for m in _FIELD.finditer(fmt):
        out += re.escape(fmt[at:m.start()]) + _FIELDS[m[0]]
        at = m.end()
    return out + re.escape(fmt[at:]) + r"\s*$"


def iso_day(text: Column) -> Column:
    """Whether text is laid out as ``yyyy-MM-dd`` and nothing else. No other
    format of DATE_FORMATS fits such text, and a cast reads it as the format
    does (other lengths of the parts make the cast fail)."""
    at = lambda k: F.substring(text, k, 1)
    return (F.length(text) == 10) & (at(5) == "-") & (at(8) == "-") & at(10).between("0", "9")


def parse_date(c, fmt: str) -> Column:
    """Text -> timestamp by ``fmt``, NULL where it does not fit. Only text of
    the format's shape reaches the parser: one that fails is far slower than
    the pattern test. Plain ISO days are cast, several times faster than the
    parser."""
    text = col(c).cast("string")
    parsed = F.when(text.rlike(date_shape(fmt)), F.try_to_timestamp(F.btrim(text), F.lit(fmt)))
    if fmt == "yyyy-MM-dd":
        parsed = F.when(iso_day(text), text.try_cast("timestamp")).otherwise(parsed)
    return parsed.cast("timestamp_ntz")


def safe_corr(y, x) -> Column:
    """Pearson r as an aggregate; NULL when either side does not vary.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant
    input, so the ratio is taken with ``try_divide``.
    """
    y, x = col(y).cast("double"), col(x).cast("double")
    keep = y.isNotNull() & x.isNotNull()          # pairwise NULL removal
    yy, xx = F.when(keep, y), F.when(keep, x)
    return F.try_divide(F.covar_pop(yy, xx), F.sqrt(F.var_pop(yy)) * F.sqrt(F.var_pop(xx)))
