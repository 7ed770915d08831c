"""Benchmark the headline queries.

Runs each query of BENCH_KEYS on $BENCH_SF_DIR (default
/root/testdata/sf0.1) with local[$BENCH_CPUS], executing the full plan into
Spark's ``noop`` sink (nothing is collected to the driver). One cold run,
then the median of $BENCH_RUNS warm runs; each timing covers building the
plan (including any small planning job) and running it. Prints ONE JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capsight.plans import catalog  # noqa: E402
from capsight.session import local_session  # noqa: E402

BENCH_KEYS = [
    "daily_utilization",        # flagship U8
    "daily_utilization_stats",  # U6
    "utilization_stats",        # U2/U3
    "trend_regression",         # T3
    "trend_line",               # T7 (row level)
    "row_index",                # T2 (row level)
    "group_summary",            # A5
    "describe",                 # A4
    "distribution_stats",       # D1
    "outliers_iqr",             # D4
    "histogram",                # D7
    "kde",                      # D9
    "monthly_summary",          # A19
    "correlation_matrix",       # A20
    "insights_daily",           # R10-R17
    "insights_all",             # R1-R17
    "clean_table",              # P9
]


def run(build, spark, sf_dir):
    """Seconds to build the plan (which may run small planning jobs, e.g.
    the quantile strategy check) and execute it fully."""
    t0 = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus))
    qs = catalog.queries()
    times, cold = {}, {}
    for k in BENCH_KEYS:
        if k not in qs:
            continue
        cold[k] = round(run(qs[k], spark, sf_dir), 3)
        times[k] = round(statistics.median(run(qs[k], spark, sf_dir) for _ in range(warm)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum of per-query median warm seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "sf": sf,
        "cpus": int(cpus),
        "spark": {"shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                  "aqe": spark.conf.get("spark.sql.adaptive.enabled")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
