"""Property tests: Spark expressions against plain-Python references on
generated values (each example is one Spark job over a list of values)."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from capsight.functions.exprs import coerce_numeric, util_class, utilization_pct, zone4

SETTINGS = settings(max_examples=25, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
num = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
                st.integers(min_value=-100, max_value=100).map(float))


def ref_util(a, c):
    if a is None or c is None:
        return 0.0
    if c != 0:
        return a / c * 100
    return math.inf if a > 0 else -math.inf if a < 0 else 0.0


@SETTINGS
@given(st.lists(st.tuples(num, num), min_size=1, max_size=40))
def test_utilization_matches_reference(spark, pairs):
    df = spark.createDataFrame(pairs, "a DOUBLE, c DOUBLE")
    got = [r.u for r in df.select(utilization_pct("a", "c").alias("u")).collect()]
    for (a, c), g in zip(pairs, got):
        want = ref_util(a, c)
        assert g == want or (math.isfinite(want) and abs(g - want) <= 1e-9 * max(1, abs(want)))


@SETTINGS
@given(st.lists(st.floats(min_value=-50, max_value=200, allow_nan=False), min_size=1,
                max_size=40))
def test_classes_partition_the_line(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "u DOUBLE")
    rows = df.select("u", util_class("u").alias("c"), zone4("u").alias("z")).collect()
    for r in rows:
        u = r.u
        assert r.c == ("red" if u < 50 else "orange" if u < 80 else "green")
        assert r.z == ("critical" if u < 50 else "moderate" if u < 80 else
                       "optimal" if u <= 100 else "over")


token = st.one_of(
    st.from_regex(r"\s?[+-]?\d{1,4}(\.\d{0,3})?([eE][+-]?\d)?\s?", fullmatch=True),
    st.sampled_from(["inf", "-inf", "Infinity", "nan", "NaN", "1,234", "1d", "2f", "abc", "",
                     " ", "1.2.3", "--1", "+5", ".5", "5.", "1e5", "0x10", "1_000"]))


@SETTINGS
@given(st.lists(token, min_size=1, max_size=40))
def test_numeric_coercion_matches_pandas(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s STRING")
    got = [r.x for r in df.select(coerce_numeric("s").alias("x")).collect()]
    want = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").tolist()
    for t, g, w in zip(texts, got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None, t
        else:
            assert g == float(w), t
