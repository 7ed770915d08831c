"""Monthly summary (A19) and its clustered-bar chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.functions.missing import missing_aware


def detect_monthly_roles(df: DataFrame) -> tuple[str, str, list[str]]:
    """First column is the group; the date is the first column whose name
    contains "date"; metrics are the columns named attendees / capacity in
    any case, in table order."""
    cols = df.columns
    date = next((c for c in cols if "date" in c.lower()), None)
    if date is None:
        raise ValueError("no date column found")
    metrics = [c for c in cols if c.lower() in ("attendees", "capacity")]
    if len(metrics) < 2:
        raise ValueError("the table must contain 'Attendees' and 'Capacity' columns")
    return cols[0], date, metrics


@missing_aware
def monthly_summary(df: DataFrame, group: str | None = None, date: str | None = None,
                    metrics: list[str] | None = None) -> DataFrame:
    """Sum of the metrics per (group, 'Mon-YYYY'); rows without a month or a
    group are left out. Sorted by the month *text* and then the group, as
    the summary sheet is; ``month_start`` gives the calendar order."""
    if group is None or date is None or metrics is None:
        g0, d0, m0 = detect_monthly_roles(df)
        group, date, metrics = group or g0, date or d0, metrics or m0
    # text dates are parsed leniently: an unparsable value becomes NULL (and
    # its row is left out), never an error
    d = F.col(date).try_cast("timestamp_ntz") if dict(df.dtypes)[date] == "string" \
        else F.col(date)
    month = F.date_format(d, "MMM-yyyy")
    src = df.where(F.col(group).isNotNull() & d.isNotNull())
    return (src.groupBy(F.col(group), month.alias("month"))
               .agg(F.min(F.trunc(d, "month")).alias("month_start"),
                    *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics])
               .orderBy("month", group))


@missing_aware
def chart_monthly(summary: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """One bar per (group, month, series), series named after the metric."""
    return summary.unpivot([group, "month", "month_start"], metrics, "series", "value")
