"""The whole dashboard as one batch job, and its command line."""

import os

from capsight.plans import report
from capsight.sources.tables import VISITS, visits_clean

from conftest import SMALL


def test_build_and_write_report(spark, tmp_dir):
    df = visits_clean(spark, SMALL)
    tables = report.build_report(df, VISITS)
    names = report.write_report(tables, f"{tmp_dir}/out")
    assert set(names) == set(os.listdir(f"{tmp_dir}/out")) - {".DS_Store"}
    back = spark.read.parquet(f"{tmp_dir}/out/insights")
    assert back.count() > 0
    daily = spark.read.parquet(f"{tmp_dir}/out/daily_utilization")
    assert daily.count() == tables["daily_utilization"].count()


def test_command_line_on_messy_csv(spark, tmp_dir):
    src = f"{tmp_dir}/in.csv"
    with open(src, "w") as f:
        f.write("Export\n\nSite,Visit date,Head count,Seats\n"
                "A,2024-01-01,5,10\nA,2024-01-03,7,10\nB,2024-01-02,9,8\n")
    report.main(["--input", src, "--out", f"{tmp_dir}/rep", "--format", "csv"])
    cards = spark.read.option("header", True).csv(f"{tmp_dir}/rep/group_cards")
    assert cards.count() == 2
    daily = spark.read.option("header", True).csv(f"{tmp_dir}/rep/daily_utilization")
    assert daily.where("`Building Name` = 'A'").count() == 3       # Jan 2 filled
