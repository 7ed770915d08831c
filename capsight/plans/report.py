"""The grouped dashboard as one batch job, for all groups at once.

The reference's page filters the table once per group and recomputes
utilization three times; here every family is one grouped plan over the
whole table, and the daily utilization series, which several outputs read
(its statistics, the daily rules, the zone chart), is computed once and
written with ``checkpoint()`` to the session's shared checkpoint folder.
That cuts its lineage, so a lost executor recomputes nothing upstream of it.

Usage::

    python -m capsight.plans.report --input data/visits.csv --out out/ \
        [--group "Building Name" --date Date --primary Attendees --secondary Capacity]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from capsight.functions.joins import reuse_materialized, stage, staging
from capsight.operators import distribution as ds
from capsight.operators import groups as gr
from capsight.operators import monthly as mo
from capsight.operators import rules as ru
from capsight.operators import timeseries as ts
from capsight.operators import utilization as ut
from capsight.roles import CANONICAL, Roles
from capsight.session import ensure_checkpoint_dir


def build_report(df: DataFrame, roles: Roles, checkpoint: bool = True) -> dict[str, DataFrame]:
    """Every output table of the dashboard, keyed by name (lazy except the
    staged input and the checkpointed daily series).

    With ``checkpoint`` the columns the report uses are first written once
    as a Parquet table in the shared checkpoint folder, so the input (a
    parsed CSV, a join) is derived once for all outputs."""
    g, p, s = roles.group, roles.primary, roles.secondary
    if checkpoint:
        cols = [c for c in dict.fromkeys([g, roles.date, p, s, *roles.order_key]) if c]
        df = stage(df, cols, "report")
    daily = ut.daily_utilization(df, roles)
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        daily = daily.checkpoint(eager=True)
    with reuse_materialized():
        out = _outputs(df, roles, daily)
    return out


def _outputs(df: DataFrame, roles: Roles, daily: DataFrame) -> dict[str, DataFrame]:
    g, p, s = roles.group, roles.primary, roles.secondary
    return {
        "group_totals": gr.group_totals(df, g, p),
        "group_cards": gr.group_cards(df, g, p, s),
        "group_summary": gr.group_summary(df, g, [p, s]),
        "trend": ts.trend_regression(df, roles),
        "attendance_vs_capacity": ut.attendance_vs_capacity(df, roles),
        "utilization_stats": ut.utilization_stats(df, roles),
        "daily_utilization": daily,
        "daily_stats": ut.daily_utilization_stats(daily, roles),
        "distribution": ds.distribution_stats(df, g, p),
        "boxplot": ds.boxplot_stats(df, g, p),
        "chart_distribution": ds.chart_distribution(df, g, p),
        "monthly_summary": mo.monthly_summary(df, g, roles.date, [p, s]),
        "insights": ru.insights_all(df, roles, daily, staged=False),
    }


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """Write each table under ``out_dir/<name>``; returns the names written."""
    for name, t in tables.items():
        w = t.write.mode("overwrite")
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
    return list(tables)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--input", required=True, help="CSV file/folder (messy allowed) or Parquet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--group", default=CANONICAL.group)
    ap.add_argument("--date", default=CANONICAL.date)
    ap.add_argument("--primary", default=CANONICAL.primary)
    ap.add_argument("--secondary", default=CANONICAL.secondary)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.input.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(a.input)
    else:
        from capsight.operators.clean import load_table
        df = load_table(spark, a.input, row_id=True)   # file order breaks date ties
    key = ("_row_id",) if "_row_id" in df.columns else ()
    roles = Roles(group=a.group, date=a.date, primary=a.primary, secondary=a.secondary,
                  order_key=key).check(df)
    with staging():
        write_report(build_report(df, roles), a.out, a.format)


if __name__ == "__main__":
    main()
