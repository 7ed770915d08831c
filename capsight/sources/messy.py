"""A messy CSV export derived by Spark from the `visits` view.

Used to exercise ingestion (S1-S5, P1-P9) on data whose size follows the
given tables. Every writing task writes its own file with a header line, so
the export scales with the cluster. The first file by name holds a title line,
a blank line, the header with its columns in another order, and the first
visits in the order of their keys. Three more files hold a title line, a blank
line, the header, a fully empty row, a row with an impossible date and a
repeated header. The body carries missing-value tokens, padded numbers, a
type-suffixed number and quoted cells with doubled quotes and commas.

Junk rules (fixed): line 7 -> head count ``N/A``; line 6 -> head count
padded with spaces; line 5 -> a quoted remark; line 4 -> seats with a ``d``
suffix.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.sources.tables import VISIT_KEY, read_table, visits_clean

HEADER = ("Site", "Visit date", "Head count", "Seats", "Note", 'Guest "remark"')
TITLE = "Quarterly visits export"
REMARK = 'said "hi", then left'
BAD_DATE = "2024-02-30"
SPARE = "one too many"
JUNK_FILES = 3
FIRST_ROWS = 6
LOWEST = 1000  # line items among which the first visits are looked for before all are joined
FIRST_ORDER = (1, 3, 0, 4, 2, 5)  # the first file's columns, as places in the header


def messy_rows(v: DataFrame, header=HEADER, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The export's body of the visits ``v``, all text, under the names of ``header``."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    ln = F.col("l_linenumber")
    head = (F.when(ln == 7, F.lit("N/A"))
             .when(ln == 6, F.concat(F.lit(" "), whole("attendees"), F.lit(" ")))
             .otherwise(whole("attendees")))
    seats = F.when(ln == 4, F.concat(whole("capacity"), F.lit("d"))).otherwise(whole("capacity"))
    cells = [F.col("building"), F.date_format("visit_date", date_format), head, seats,
             F.col("l_orderkey").cast("string"), F.when(ln == 5, F.lit(REMARK))]
    return v.select(*[c.alias(n) for c, n in zip(cells, header)])


def _line(cells) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def _upto(visits: DataFrame, last) -> tuple[DataFrame, F.Column]:
    """The visits up to the key ``last``, found by a filter that reaches the
    scan, and the condition itself."""
    key = F.struct(*VISIT_KEY)
    end = F.struct(*[F.lit(v).cast(visits.schema[c].dataType).alias(c) for c, v in zip(VISIT_KEY, last, strict=True)])
    lead = F.col(VISIT_KEY[0])
    near = lead.isNull() if last[0] is None else lead.isNull() | (lead <= last[0])
    return visits.where(near & (key <= end)), key <= end


def _first_key(spark: SparkSession, sf_dir: str, visits: DataFrame, n: int):
    """The key of the n-th visit in order of keys, or of the last one, if there
    are fewer; None without visits. Visits of the smallest line items come
    first, so when these give n, no other line item is joined for it."""
    low = read_table(spark, sf_dir, "lineitem").select(*VISIT_KEY).orderBy(*VISIT_KEY).limit(LOWEST).collect()
    head = []
    if len(low) == LOWEST:
        head = _upto(visits, low[-1])[0].select(*VISIT_KEY).orderBy(*VISIT_KEY).limit(n).collect()
    if len(head) < n:
        head = visits.select(*VISIT_KEY).orderBy(*VISIT_KEY).limit(n).collect()
    return head[-1] if head else None


def write_messy(spark: SparkSession, sf_dir: str, out: str, header=HEADER, date_format: str = "yyyy-MM-dd",
                bad_date: str = BAD_DATE, bad_rows: int = 1, first_rows: int = FIRST_ROWS,
                spoil_line: int | None = None) -> str:
    """Write the export under ``out`` (folders ``a-first``, ``a-junk`` and
    ``b-body``) and return it. Every visit is in one file: the ``first_rows``
    smallest keys (and equal ones) in the first, the others in the body. The
    body's visits of line ``spoil_line`` stand in ``c-wide`` instead, without a
    header and with one field too many (``SPARE``)."""
    visits = visits_clean(spark, sf_dir)
    last = _first_key(spark, sf_dir, visits, first_rows) if first_rows else None
    if last:
        first, in_first = _upto(visits, last)
        rows = messy_rows(first.orderBy(*VISIT_KEY, "visit_date", "attendees"), header, date_format).collect()
        order = [header[k] for k in FIRST_ORDER]
        lines = [TITLE, "", _line(order), *[_line(["" if r[c] is None else r[c] for c in order]) for r in rows]]
        spark.createDataFrame([(t,) for t in lines], "value STRING").coalesce(1).write.mode("overwrite").text(f"{out}/a-first")
        visits = visits.where(~in_first)
    lines = [TITLE, "", _line(header), "," * (len(header) - 1),
             *[_line(["Brand#99", bad_date, "5", "10", "0", ""])] * bad_rows, _line(header)]
    junk = spark.createDataFrame([(t,) for t in lines], "value STRING").coalesce(1)
    for p in range(JUNK_FILES):
        junk.write.mode("overwrite").text(f"{out}/a-junk/{p}")
    if spoil_line is not None:
        spoilt = messy_rows(visits.where(F.col("l_linenumber") == spoil_line), [f"c{k}" for k in range(len(header))], date_format)
        (spoilt.withColumn("spare", F.lit(SPARE)).write.mode("overwrite").option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{out}/c-wide"))
        visits = visits.where(F.col("l_linenumber") != spoil_line)
    (messy_rows(visits, header, date_format).write.mode("overwrite").option("header", True)
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(f"{out}/b-body"))
    return out
