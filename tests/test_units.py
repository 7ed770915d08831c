"""Boundary and quirk tests on tiny frames (thresholds, n = 0/1/2, ties,
gaps, NULL and zero handling), and differential tests against pandas/NumPy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capsight.functions.exprs import coerce_numeric, utilization_pct
from capsight.operators import distribution as ds
from capsight.operators import filters as fl
from capsight.operators import groups as gr
from capsight.operators import monthly as mo
from capsight.operators import profile as pf
from capsight.operators import timeseries as ts
from capsight.operators import utilization as ut
from capsight.roles import Roles

R = Roles(group="g", date="d", primary="a", secondary="c", order_key=("k",))
SCHEMA = "g STRING, d TIMESTAMP_NTZ, a DOUBLE, c DOUBLE, k INT"


def day(n, month=1):
    return dt.datetime(2024, month, 1) + dt.timedelta(days=n - 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# -- U1 ----------------------------------------------------------------------------
def test_utilization_null_zero_infinity(spark):
    df = spark.createDataFrame([(None, 10.0), (5.0, None), (0.0, 0.0), (5.0, 0.0), (-5.0, 0.0),
                                (5.0, 10.0)], "a DOUBLE, c DOUBLE")
    got = [r.u for r in df.select(utilization_pct("a", "c").alias("u")).collect()]
    assert got == [0.0, 0.0, 0.0, math.inf, -math.inf, 50.0]


# -- U3 / U4 / U5 boundaries -------------------------------------------------------------
BANDS = [0.0, 49.99, 50.0, 79.99, 80.0, 80.01, 100.0, 100.01]


def test_three_band_boundaries(spark):
    df = frame(spark, [("x", day(1), u, 100.0, i) for i, u in enumerate(BANDS)])
    r = ut.utilization_stats(df, R).first()
    assert (r.low_rows, r.optimal_rows, r.high_rows) == (2, 3, 3)


def test_four_zone_boundaries_and_class(spark):
    df = frame(spark, [("x", day(i + 1), u, 100.0, i) for i, u in enumerate(BANDS)])
    d = ut.daily_utilization(df, R)
    zones = {round(r.occupied_pct, 2): r.zone for r in d.collect()}
    assert zones == {0: "critical", 49.99: "critical", 50: "moderate", 79.99: "moderate",
                     80: "optimal", 80.01: "optimal", 100: "optimal", 100.01: "over"}
    s = ut.daily_utilization_stats(d, R).first()
    assert (s.critical_days, s.moderate_days, s.optimal_days, s.over_days) == (2, 2, 3, 1)
    cls = {round(r.utilization_pct, 2): r.util_class
           for r in ut.attendance_vs_capacity(df, R).collect()}
    assert cls[49.99] == "red" and cls[50] == "orange" and cls[79.99] == "orange"
    assert cls[80] == "green"


# -- T3-T6 -------------------------------------------------------------------------------
def test_trend_small_n_constant_and_zero_first(spark):
    rows = [("one", day(1), 5.0, 10.0, 1),
            ("two", day(1), 0.0, 10.0, 1), ("two", day(2), 4.0, 10.0, 2),
            ("flat", day(1), 3.0, 10.0, 1), ("flat", day(2), 3.0, 10.0, 2),
            ("flat", day(3), 3.0, 10.0, 3)]
    t = {(r.g, r.metric): r for r in ts.trend_regression(frame(spark, rows), R).collect()}
    one = t[("one", "a")]
    assert one.n == 1 and one.slope is None and one.direction == "unknown" and one.strength is None
    two = t[("two", "a")]
    assert two.slope == pytest.approx(4.0) and two.direction == "up"
    assert two.change_pct == 0.0          # first value 0 -> change 0
    flat = t[("flat", "a")]
    assert flat.r == 0.0 and flat.r2 == 0.0 and flat.strength == "weak"
    assert flat.direction == "stable"


def test_trend_nulls_count_as_zero_and_ties_use_key(spark):
    rows = [("x", day(1), 2.0, 1.0, 2), ("x", day(1), None, 1.0, 1), ("x", day(2), 6.0, 1.0, 3)]
    idx = {r.k: r.row_index for r in ts.row_index(frame(spark, rows), R).collect()}
    assert idx == {1: 0, 2: 1, 3: 2}
    t = {r.metric: r for r in ts.trend_regression(frame(spark, rows), R).collect()}
    y = np.array([0.0, 2.0, 6.0])
    slope, icpt = np.polyfit(np.arange(3), y, 1)
    assert t["a"].slope == pytest.approx(slope) and t["a"].intercept == pytest.approx(icpt)


def test_trend_pieces_join_to_the_whole(spark):
    """One group holds most rows, all in one hour; every split gives the same."""
    rng = np.random.default_rng(8)
    rows = [("hot", day(1), float(v), float(i), i) for i, v in enumerate(rng.normal(1e6, 3, 4000))]
    rows += [(f"g{i % 40}", day(1 + i % 9), float(rng.normal()), 0.1, 10_000 + i) for i in range(1500)]
    df = frame(spark, rows).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({(r.g, r.metric): r for r in ts.trend_regression(df, R).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[4]))
        for m, at in (("a", 2), ("c", 3)):
            y = np.array([r[at] for r in mine])
            slope, icpt = np.polyfit(np.arange(len(y)), y, 1)
            flat = y.min() == y.max()
            corr = 0.0 if flat else np.corrcoef(np.arange(len(y)), y)[0, 1]
            for f in found:
                r = f[(g, m)]
                assert (r.n, r.first_value, r.last_value) == (len(y), y[0], y[-1])
                assert r.r == pytest.approx(corr, abs=1e-9) and (not flat or r.r == 0.0)
                assert r.slope == pytest.approx(slope, abs=1e-8, rel=1e-8)
                assert r.intercept == pytest.approx(icpt, abs=1e-7, rel=1e-9)


def test_recent_vs_earlier(spark):
    rows = [("x", day(i), float(i), 10.0, i) for i in range(1, 8)]
    r = ts.recent_vs_earlier(frame(spark, rows), R).first()
    assert r.earlier_mean == pytest.approx(20.0) and r.recent_mean == pytest.approx(60.0)


# -- T9 / T10 gaps ---------------------------------------------------------------------------
def test_gap_fill_and_month_end(spark):
    rows = [("x", day(1), 5.0, 10.0, 1), ("x", day(4), 8.0, 10.0, 2),
            ("y", dt.datetime(2024, 1, 30), 1.0, 10.0, 1), ("y", dt.datetime(2024, 2, 2), 2.0, 10.0, 2)]
    d = {(r.g, r.day): r for r in ts.daily_ffill(frame(spark, rows), R).collect()}
    xs = sorted(k[1] for k in d if k[0] == "x")
    assert len(xs) == 4 and d[("x", dt.date(2024, 1, 3))].occupied_pct == 50.0
    assert d[("x", dt.date(2024, 1, 3))].is_filled and d[("x", dt.date(2024, 1, 3))].rows == 0
    ys = sorted(k[1] for k in d if k[0] == "y")
    assert ys == [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1),
                  dt.date(2024, 2, 2)]


def test_daily_single_day(spark):
    d = ut.daily_utilization(frame(spark, [("x", day(1), 5.0, 10.0, 1)]), R)
    r = d.first()
    assert r.trend is None and r.is_peak and r.is_low
    s = ut.daily_utilization_stats(d, R).first()
    assert s.std_pct is None and s.direction == "unknown" and s.slope_per_day == 0.0


def test_daily_matches_pandas_resample_ffill(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n),
        "d": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 90 * 24, n), unit="h"),
        "a": rng.integers(0, 60, n).astype(float), "c": rng.integers(1, 50, n).astype(float)})
    pdf["k"] = np.arange(n)
    df = spark.createDataFrame(pdf, SCHEMA)
    got = {(r.g, pd.Timestamp(r.day)): r.occupied_pct for r in ts.daily_ffill(df, R).collect()}
    for g, grp in pdf.groupby("g"):
        s = grp.sort_values("d").copy()
        s["u"] = (s.a / s.c * 100).fillna(0)
        ref = s.set_index("d")[["u"]].resample("D").mean().ffill()
        for ts_, v in ref["u"].items():
            assert got[(g, ts_)] == pytest.approx(v)
        assert sum(1 for k in got if k[0] == g) == len(ref)


# -- A9-A15 ------------------------------------------------------------------------------------
def test_group_nulls_ties_and_all_null(spark):
    rows = [("a", day(1), None, 1.0, 1), ("a", day(1), None, 1.0, 2),
            ("b", day(1), 5.0, 1.0, 3), ("c", day(1), 5.0, 1.0, 4), (None, day(1), 99.0, 1.0, 5)]
    df = frame(spark, rows)
    got = {r.g: r.value for r in gr.compare_groups(df, "g", "a", "sum").collect()}
    assert got == {"a": 0.0, "b": 5.0, "c": 5.0}          # null key gone, all-null sum 0
    mean = {r.g: r.value for r in gr.compare_groups(df, "g", "a", "mean").collect()}
    assert mean["a"] is None
    bw = gr.best_worst_group(df, "g", "a").first()
    assert bw.best_group == "b" and bw.worst_group == "a"   # tie b/c -> smallest key
    with pytest.raises(ValueError):
        gr.compare_groups(df, "g", "a", "mode")
    with pytest.raises(ValueError):
        gr.compare_groups(df, "nope", "a")


# -- D1-D10 -------------------------------------------------------------------------------------
def test_distribution_small_constant_and_pandas(spark):
    rng = np.random.default_rng(3)
    vals = rng.lognormal(size=200)
    rows = [("big", float(v)) for v in vals] + [("two", 1.0), ("two", 2.0)] + \
           [("flat", 4.0)] * 5
    df = spark.createDataFrame(rows, "g STRING, a DOUBLE")
    s = {r.g: r for r in ds.distribution_stats(df, "g", "a").collect()}
    assert s["two"].skewness is None
    assert s["flat"].skewness == 0.0 and s["flat"].skew_class == "symmetric"
    ser = pd.Series(vals)
    assert s["big"].skewness == pytest.approx(ser.skew())
    assert s["big"].median == pytest.approx(ser.median())
    assert s["big"].std == pytest.approx(ser.std())
    box = {r.g: r for r in ds.outliers_iqr(df, "g", "a").collect()}
    q1, q3 = ser.quantile(0.25), ser.quantile(0.75)
    iqr = q3 - q1
    assert box["big"].outliers == int(((ser < q1 - 1.5 * iqr) | (ser > q3 + 1.5 * iqr)).sum())
    z = {r.g: r.outliers_3sigma for r in ds.outliers_zscore(df, "g", "a").collect()}
    assert z["big"] == int((np.abs((ser - ser.mean()) / ser.std()) > 3).sum())
    assert z["flat"] == 0


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.normal(50, 15, 500), 3)
    df = spark.createDataFrame([("x", float(v)) for v in vals] + [("k", 2.0)] * 3,
                               "g STRING, a DOUBLE")
    h = {(r.g, r.bin): r["count"] for r in ds.histogram(df, "g", "a").collect()}
    counts, _ = np.histogram(vals, bins=30)
    assert [h[("x", b)] for b in range(30)] == counts.tolist()
    kc, _ = np.histogram(np.array([2.0] * 3), bins=30)
    assert [h[("k", b)] for b in range(30)] == kc.tolist()


def test_kde_matches_closed_form(spark):
    vals = np.array([1.0, 2.0, 2.0, 3.5, 7.0, 8.0])
    df = spark.createDataFrame([("x", float(v)) for v in vals], "g STRING, a DOUBLE")
    out = sorted(ds.kde(df, "g", "a", points=50).collect(), key=lambda r: r.point)
    h = vals.std(ddof=1) * len(vals) ** -0.2
    lo, hi = vals.min() - 0.5 * np.ptp(vals), vals.max() + 0.5 * np.ptp(vals)
    grid = np.linspace(lo, hi, 50)
    ref = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(1) / (
        len(vals) * h * math.sqrt(2 * math.pi))
    assert [r.density for r in out] == pytest.approx(ref.tolist())


def test_kde_of_a_long_tail(spark):
    """Far values are worked out only at the points their kernels reach."""
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1, 3000), [-2e5, 1e5, 1e5, 3e6]])
    rows = [("x", float(v)) for v in vals] + [(None, 1.0), ("flat", 2.0), ("y", 1.0), ("y", 4.0)]
    df = spark.createDataFrame(rows, "g STRING, a DOUBLE").repartition(3)
    out = ds.kde(df, "g", "a", points=200).collect()
    assert {r.g for r in out} == {"x", "y"}
    h = vals.std(ddof=1) * len(vals) ** -0.2
    lo, hi = vals.min() - 0.5 * np.ptp(vals), vals.max() + 0.5 * np.ptp(vals)
    z = (np.linspace(lo, hi, 200)[:, None] - vals) / h
    ref = np.exp(-0.5 * z * z).sum(1) / (len(vals) * h * math.sqrt(2 * math.pi))
    got = [r.density for r in sorted((r for r in out if r.g == "x"), key=lambda r: r.point)]
    assert got == pytest.approx(ref.tolist(), rel=1e-6, abs=1e-40)


def test_kernel_terms_fall_with_the_bandwidth():
    x = np.sort(np.random.default_rng(6).uniform(0, 1, 4000))
    terms, step = {}, 2.0 / 999
    for h in (1.0, 1e-3, 1e-5):
        dense = np.zeros(1000)
        for i, j, a, b in ds.kernel_windows(x, h, -0.5, step, 1000):
            z = (-0.5 + step * np.arange(a, b)[:, None] - x[i:j]) / h
            dense[a:b] += np.exp(-0.5 * z * z).sum(1)
            terms[h] = terms.get(h, 0) + (j - i) * (b - a)
        z = (-0.5 + step * np.arange(1000)[:, None] - x) / h
        assert dense == pytest.approx(np.exp(-0.5 * z * z).sum(1), rel=1e-9, abs=1e-300)
    assert terms[1.0] == 4000 * 1000
    assert terms[1e-3] < 4000 * 100 and terms[1e-5] < 4000 * 3


def test_top_values_of_long_tails(spark, monkeypatch):
    """Equal to plain counts, whatever the summary names: a heavy head over a
    long tail, all values alike, few values, nothing, ties and clashing names."""
    from collections import Counter
    data = [(f"h{i % 7}" if i % 3 else f"t{i:05d}", f"u{i:05d}", "yes" if i % 5 else None, None, f"v{i % 40:02d}")
            for i in range(6000)]
    cols = ["column", "value", "bucket", "none", "count"]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` STRING" for c in cols)).repartition(4)

    def want():
        for j, c in enumerate(cols):
            n = Counter(r[j] for r in data if r[j] is not None)
            for rank, (v, m) in enumerate(sorted(n.items(), key=lambda t: (-t[1], t[0]))[:5], 1):
                yield c, v, m, rank
    got = lambda: sorted((r["column"], r["value"], r["count"], r["rank"]) for r in pf.top_values(df, cols).collect())
    assert got() == sorted(want())
    wrong = spark.range(1).select(F.xxhash64(F.lit("t00003"))).first()[0]
    monkeypatch.setattr(pf, "_named", lambda df, cols, k: {c: [wrong] if c == "column" else [] for c in cols})
    assert got() == sorted(want())


def test_top_values_leave_the_tail_uncounted(spark):
    """Where the head is frequent no value of the tail is counted singly."""
    df = spark.range(60000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), F.col("id") % 10))
                                   .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("a"))
    top = pf.top_values(df)
    assert [(r["value"], r["count"]) for r in top.orderBy("rank").collect()] == [(f"h{i}", 6000) for i in (0, 2, 4, 6, 8)]
    assert "Generate" not in top._jdf.queryExecution().toString()


def test_boxplot_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]  # noqa
    df = spark.createDataFrame([("x", float(v)) for v in vals], "g STRING, a DOUBLE")
    b = ds.boxplot_stats(df, "g", "a").first()
    assert b.whisker_high == 8.0 and b.whisker_low == 1.0 and b.fliers == 1


# -- A3 / A4 / A20 ----------------------------------------------------------------------------------
def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(size=100), "y": rng.integers(0, 9, 100).astype(float)})
    pdf.loc[3, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r.column: r for r in pf.describe(df).collect()}
    ref = pdf.describe()
    for c in ("x", "y"):
        assert got[c]["count"] == ref.loc["count", c]
        for a, b in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"),
                     ("p75", "75%"), ("min", "min"), ("max", "max")):
            assert getattr(got[c], a) == pytest.approx(ref.loc[b, c])
    corr = {(r.col_x, r.col_y): r.r for r in pf.correlation_matrix(df).collect()}
    assert corr[("x", "y")] == pytest.approx(pdf.corr().loc["x", "y"])


def test_overview_and_profile(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("a", 3.0)], "s STRING, v DOUBLE")
    o = pf.overview(df).first()
    assert (o.rows, o.columns, o.missing) == (3, 2, 2)
    prof = {r.column: r for r in pf.column_profile(df).collect()}
    assert prof["s"].distinct == 1 and prof["s"].missing == 1
    top = pf.top_values(df).collect()
    assert [(r.column, r.value, r["count"]) for r in top] == [("s", "a", 2)]
    assert [c for c, _, k in pf.classify_columns(df) if k == "numeric"] == ["v"]


# -- P11-P16 ----------------------------------------------------------------------------------------
def test_filters(spark):
    df = spark.createDataFrame([(5.0, "Alpha"), (6.0, None), (None, "beta")], "v DOUBLE, s STRING")
    assert fl.filter_data(df, "v", "equals", "5").count() == 1          # typed equality
    assert fl.filter_data(df, "s", "contains", "A").count() == 2        # case-insensitive
    assert fl.filter_data(df, "s", "contains", "nan").count() == 0      # missing never matches
    s = fl.filter_summary(df, "v", ">", "5.5").first()
    assert (s.matches, s.rows) == (1, 3) and s.match_pct == pytest.approx(100 / 3)
    with pytest.raises(ValueError):
        fl.filter_data(df, "v", "~", "1")
    with pytest.raises(ValueError):
        fl.filter_data(df, "zz", ">", "1")


def test_coerce_numeric_like_pandas(spark):
    vals = [" 12 ", "1,234", "1d", "inf", "nan", "abc", "3.5", "-2", None]
    df = spark.createDataFrame([(v,) for v in vals], "s STRING")
    got = [r.x for r in df.select(coerce_numeric("s").alias("x")).collect()]
    ref = pd.to_numeric(pd.Series(vals), errors="coerce").tolist()
    for g, r in zip(got, ref):
        assert (g is None and (r is None or math.isnan(r))) or g == r


# -- A19 ---------------------------------------------------------------------------------------------
def test_monthly_summary_text_order(spark):
    df = spark.createDataFrame(
        [("B1", dt.datetime(2024, 1, 5), 3.0, 10.0), ("B1", dt.datetime(2024, 4, 2), 4.0, 10.0),
         ("B1", None, 1.0, 1.0)], "Building STRING, Visit_Date TIMESTAMP_NTZ, "
        "Attendees DOUBLE, Capacity DOUBLE")
    out = mo.monthly_summary(df).collect()
    assert [r.month for r in out] == ["Apr-2024", "Jan-2024"]
    with pytest.raises(ValueError):
        mo.monthly_summary(df.drop("Capacity"))


def test_roles_validation(spark):
    with pytest.raises(ValueError):
        Roles(group="g", date="d", primary="a", secondary="a")
    with pytest.raises(ValueError):
        R.check(spark.createDataFrame([(1,)], "g INT"))


# -- exact quantiles by selection ------------------------------------------------------------
def test_exact_quantiles_match_pandas(spark):
    from capsight.operators import quantiles as qt
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 3000, p=[0.8, 0.15, 0.05]),
                        "x": np.round(rng.lognormal(size=3000), 4)})
    pdf.loc[:5, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = {r.g: r for r in qt.exact_quantiles(df, ["g"], "x", probs, names).collect()}
    for g, grp in pdf.groupby("g"):
        for nm, p in zip(names, probs):
            assert getattr(got[g], nm) == pytest.approx(grp.x.quantile(p))
    whole = qt.exact_quantiles(df, [], "x", [0.5], ["m"]).first()
    assert whole.m == pytest.approx(pdf.x.median())


def test_quantiles_of_infinities(spark):
    from capsight.operators import quantiles as qt
    inf = float("inf")
    df = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 2.0)]
                               + [("c", v) for v in (1.0, 5.0, inf)] + [("d", None), ("d", float("nan"))],
                               "g STRING, x DOUBLE")
    out = qt.stats_with_quantiles(df, ["g"], "x", [F.count("x").alias("n")], [0.25, 0.5, 1.0], ["q1", "q2", "q3"])
    rows = sorted((r.g, r.q1, r.q2, r.q3) for r in out.where("g <> 'd'").collect())
    assert rows == [("a", 2.5, 5.0, 10.0), ("b", 2.0, 2.0, 2.0), ("c", 3.0, 5.0, inf)]
    last = out.where("g = 'd'").first()
    assert last.q1 is None and last.q3 is None


def test_quantiles_with_one_value_filling_a_group(spark):
    """A value that 90 % of a group share is one row before the ranks are
    looked for, so no task ranks the group."""
    from capsight.operators import quantiles as qt
    df = spark.range(20_000).selectExpr("'g' AS g", "CASE WHEN id % 10 < 9 THEN 7.0D ELSE CAST(id AS DOUBLE) END AS x")
    first = df.groupBy("g").agg(*qt._interval(F.col("x"))).select("g", "_qn", qt._whole().alias("_iv")).checkpoint()
    rows = df.select("g", F.col("x").alias("_v"))
    seen = qt._located(rows, ["g"], first, [0.5], single=True, whole=True).collect()
    assert {(r["_c"], r["_lo"], r["_start"]) for r in seen} == {(18_000, 7.0, 0)}
    got = qt.exact_quantiles(df, ["g"], "x", [0.5, 0.95, 1.0], ["m", "p", "top"]).first()
    pdf = df.toPandas().x
    assert (got.m, got.p, got.top) == (7.0, pdf.quantile(0.95), 19999.0)


def test_quantiles_of_intervals_cut_many_times(spark, monkeypatch):
    """Every group's interval is cut until few rows are left: heavy tails, both
    signs, ties, infinities; groups of every size beside each other."""
    from capsight.operators import quantiles as qt
    rng = np.random.default_rng(11)
    inf = float("inf")
    groups = {"tail": np.exp(rng.normal(0, 6, 900)), "signs": rng.normal(0, 1, 700), "ties": rng.integers(0, 5, 500) * 1.0,
              "ends": np.array([-inf] * 40 + [inf] * 30 + list(rng.normal(0, 1e300, 200)) + [1.7e308, -1.7e308]),
              "infinite": np.array([inf, inf, -inf] * 30), "one": np.array([3.0]), "few": rng.normal(0, 1, 7)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for bins, move, most in ((64, 16, 6), (3, 4, 2)):
        for k, v in (("BINS", bins), ("MOVE", move), ("MOST_CUTS", most)):
            monkeypatch.setattr(qt, k, v)
        got = {r["g"]: r for r in qt.exact_quantiles(df, ["g"], "x", probs, names).collect()}
        for g, vs in groups.items():
            vs = np.sort(vs)
            for p, name in zip(probs, names):
                h = (len(vs) - 1) * p
                lo, hi = vs[int(h)], vs[min(int(h) + 1, len(vs) - 1)]
                want = lo if h == int(h) or lo == hi else lo + (h - int(h)) * (hi - lo)
                assert got[g][name] == want or np.isclose(got[g][name], want), (g, p)


def test_quantiles_see_appended_rows(spark, tmp_dir):
    from capsight.operators import quantiles as qt
    for part in (range(3), range(100, 103)):
        spark.createDataFrame([(float(v),) for v in part], "x DOUBLE").write.mode("append").parquet(f"{tmp_dir}/t")
        got = qt.exact_quantiles(spark.read.parquet(f"{tmp_dir}/t"), [], "x", [1.0], ["top"]).first().top
        assert got == max(part)


def test_gap_fill_has_no_bound_unless_asked(spark):
    rows = [("x", dt.datetime(1900, 1, 1), 1.0, 1.0, 1), ("x", dt.datetime(2024, 1, 1), 1.0, 1.0, 2)]
    assert ts.daily_ffill(frame(spark, rows), R).count() == (dt.date(2024, 1, 1) - dt.date(1900, 1, 1)).days + 1
    daily = ts.with_sum_ratio(ts.daily_mean(frame(spark, rows), R))
    with pytest.raises(Exception, match="gap of more than"):
        ts.fill_days(daily, R, max_gap=36_600).collect()


def test_contains_reads_numbers_in_plain_decimals(spark):
    df = spark.createDataFrame([(12345678.0,), (0.00025,), (1.5,), (1e20,)], "x DOUBLE")
    found = lambda v: [r.x for r in fl.filter_data(df, "x", "contains", v).collect()]
    assert found("^12345678\\.0$") == [12345678.0]
    assert found("^0\\.00025$") == [0.00025] and found("^1\\.5$") == [1.5]


def test_nan_is_missing(spark, tmp_dir):
    from capsight.sources.tables import read_table
    spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k int, x double").write.parquet(f"{tmp_dir}/t.parquet")
    df = read_table(spark, tmp_dir, "t")
    assert [r.x for r in fl.head(df, ["k"]).collect()] == [1.0, None]
    assert [r.x for r in fl.filter_data(df, "k", ">", "0").orderBy("k").collect()] == [1.0, None]
    assert gr.compare_groups(df.selectExpr("'a' AS g", "x"), "g", "x", "mean").first()["value"] == 1.0


def test_describe_dates_stay_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30), 1.0), (dt.datetime(2024, 1, 1), 2.0)],
                               "d TIMESTAMP_NTZ, x DOUBLE")
    got = {r["column"]: r for r in pf.describe(df).collect()}
    assert got["d"].max_ts == dt.datetime(2024, 3, 10, 2, 30) and got["d"]["max"] is None
    assert got["x"]["max"] == 2.0 and got["x"].max_ts is None


def test_range_filter_needs_numeric_and_text_dates_parse_leniently(spark):
    df = spark.createDataFrame([("a", "2024-01-05", 1.0, 2.0), ("b", "junk", 1.0, 2.0)],
                               "Site STRING, Date STRING, Attendees DOUBLE, Capacity DOUBLE")
    with pytest.raises(ValueError, match="numeric"):
        fl.filter_data(df, "Site", ">", "1")
    out = mo.monthly_summary(df).collect()
    assert [(r.Site, r.month) for r in out] == [("a", "Jan-2024")]


def test_describe_dates_do_not_depend_on_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 1, 1),)],
                               "d TIMESTAMP_NTZ")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = pf.describe(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert la["min_ts"] == dt.datetime(2024, 1, 1)
    assert la["max_ts"] == dt.datetime(2024, 3, 10, 2, 30)   # no DST shift


def test_row_index_plans_agree(spark, monkeypatch):
    rows = [("x", day(1 + i % 3), float(i), 10.0, i) for i in range(40)] + \
           [("y", None, 1.0, 1.0, 100), ("y", day(2), 2.0, 1.0, 101)]
    df = frame(spark, rows)
    cols = ["g", "k", "row_index", "group_rows"]
    a = sorted(tuple(r) for r in ts.row_index(df, R, "bucket").select(*cols).collect())
    b = sorted(tuple(r) for r in ts.row_index(df, R, "range").select(*cols).collect())
    assert a == b
    monkeypatch.setattr(ts, "HOT_BUCKET_ROWS", 5)           # auto switches to range
    c = sorted(tuple(r) for r in ts.row_index(df, R).select(*cols).collect())
    assert c == a
    e = sorted((r.g, r.row_index) for r in ts.edge_rows(df, R, 3).collect())
    assert e == sorted((g, i) for g, _, i, n in a if i < 3 or i >= n - 3)


def test_missing_role_columns_are_reported(spark):
    df = spark.createDataFrame([("x", 1.0)], "g STRING, a DOUBLE")
    for op in (ut.daily_utilization, ut.utilization_stats, ts.trend_regression):
        with pytest.raises(ValueError, match="missing columns"):
            op(df, R)
