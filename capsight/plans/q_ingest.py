"""Catalog: ingestion (S1-S5, S7-S9, P1-P9) on a messy export that Spark
derives from the `visits` view, and the sinks' write + read-back."""

from __future__ import annotations

from pyspark.sql import functions as F

from capsight.operators import clean as cl
from capsight.operators import monthly as mo
from capsight.plans.base import register, rounded, view
from capsight.plans.q_groups import _MONTHLY
from capsight.session import scratch_dir
from capsight.sources import csv_ingest as ci
from capsight.sources import messy, sinks


def _export(spark, sf, **kw):
    return messy.write_messy(spark, sf, scratch_dir(spark, "messy"), **kw)


_TXT = "CAST(CAST({c} AS BIGINT) AS VARCHAR)"
_NAMES = """'Site', 'Visit date', 'Head count', 'Seats', 'Note', 'Guest "remark"'"""
_BODY = f"""SELECT building AS "Site", strftime(visit_date, '%Y-%m-%d') AS "Visit date",
  CASE WHEN l_linenumber = 7 THEN 'N/A'
       WHEN l_linenumber = 6 THEN ' ' || {_TXT.format(c='attendees')} || ' '
       ELSE {_TXT.format(c='attendees')} END AS "Head count",
  CASE WHEN l_linenumber = 4 THEN {_TXT.format(c='capacity')} || 'd'
       ELSE {_TXT.format(c='capacity')} END AS "Seats",
  CAST(l_orderkey AS VARCHAR) AS "Note",
  CASE WHEN l_linenumber = 5 THEN 'said "hi", then left' END AS "Guest ""remark""\" FROM visits
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM range(3)
UNION ALL SELECT {_NAMES} FROM range(3)
UNION ALL SELECT 'Brand#99', '2024-02-30', '5', '10', '0', NULL FROM range(3)"""


# The first file by name: title, the header in another order, the first visits.
_FIRST = f"""SELECT "Visit date", "Seats", "Site", "Note", "Head count", "Guest ""remark""\", k FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, visit_date, attendees) AS k FROM (
  {_BODY.split("UNION ALL")[0].replace("SELECT building", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, visit_date, attendees, building", 1)}))
  WHERE k <= 6"""
_FIRST_NAMES = """'Visit date', 'Seats', 'Site', 'Note', 'Head count', 'Guest "remark"'"""


@register("preview_raw", f"""SELECT CAST(k + 1 AS INTEGER) AS "row", "Visit date" AS c0, "Seats" AS c1, "Site" AS c2,
  "Note" AS c3, "Head count" AS c4, "Guest ""remark""\" AS c5 FROM ({_FIRST})
UNION ALL SELECT 0, 'Quarterly visits export', NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 1, {_FIRST_NAMES}""")
def q_preview_raw(spark, sf):
    prev = ci.preview_raw(spark, _export(spark, sf))
    w = len(prev[0])
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(prev)],
        "row INT, " + ", ".join(f"c{k} STRING" for k in range(w)))


@register("detect_header", f"""SELECT CAST(1 AS INTEGER) AS header_row_index, CAST(p - 1 AS INTEGER) AS place,
  [{_FIRST_NAMES}][p] AS name, ["Visit date", "Seats", "Site", "Note", "Head count", "Guest ""remark""\"][p] AS below
FROM ({_FIRST}), (SELECT unnest(range(1, 7)) AS p) WHERE k = 1""")
def q_detect_header(spark, sf):
    """The header's place and names, and the cell under each name."""
    st = ci.analyze_structure(spark, _export(spark, sf))
    below = st.preview[st.header_row_index + 1]
    return spark.createDataFrame([(st.header_row_index, k, n, below[k]) for k, n in enumerate(st.header)],
                                 "header_row_index INT, place INT, name STRING, below STRING")


@register("detect_roles", """SELECT * FROM (VALUES ('attendees', 'Head count'), ('building_name', 'Site'),
  ('capacity', 'Seats'), ('date', 'Visit date')) AS t(role, source)""", views=())
def q_detect_roles(spark, sf):
    st = ci.analyze_structure(spark, _export(spark, sf))
    return spark.createDataFrame(sorted(st.column_mappings.items()), "role STRING, source STRING")


@register("scan_csv_header_offset", _BODY)
def q_scan_csv_header_offset(spark, sf):
    path = _export(spark, sf)
    prev = ci.preview_raw(spark, path)
    idx, _, _ = ci.detect_header(prev)
    return ci.scan_csv_header_offset(spark, path, prev, idx)


@register("null_tokens", f"""SELECT "Site", "Visit date",
  CASE WHEN "Head count" = 'N/A' THEN NULL ELSE "Head count" END AS "Head count",
  "Seats", "Note", "Guest ""remark""\" FROM ({_BODY})""")
def q_null_tokens(spark, sf):
    path = _export(spark, sf)
    prev = ci.preview_raw(spark, path)
    idx, _, _ = ci.detect_header(prev)
    return ci.null_tokens(ci.scan_csv_header_offset(spark, path, prev, idx))


# The repeated header among the data makes every other column text.
_CLEAN = """SELECT building AS "Building Name",
  CAST(CAST(visit_date AS DATE) AS TIMESTAMP) AS "Date", attendees AS "Attendees",
  capacity AS "Capacity", CAST(l_orderkey AS VARCHAR) AS "Note",
  CASE WHEN l_linenumber = 5 THEN 'said "hi", then left' END AS "Guest ""remark""\"
FROM visits WHERE l_linenumber NOT IN (4, 7)"""


@register("clean_table", _CLEAN)
def q_clean_table(spark, sf):
    return rounded(cl.clean_table(spark, _export(spark, sf)).table)


_OTHER_NAMES = ("Building", "Date", "Total Attendees", "Capacity", "Note", 'Guest "remark"')


@register("clean_table_total", _CLEAN)
def q_clean_table_total(spark, sf):
    """Headers in which a word fits both counts."""
    return rounded(cl.clean_table(spark, _export(spark, sf, header=_OTHER_NAMES)).table)


@register("clean_table_late_dates", _CLEAN)
def q_clean_table_late_dates(spark, sf):
    """Day-first dates that no preview row shows."""
    path = _export(spark, sf, date_format="d/M/yyyy", bad_date="N/A", bad_rows=12, first_rows=0)
    return rounded(cl.clean_table(spark, path).table)


@register("quarantine_records", """SELECT 'more than 6 fields' AS reason, building AS site,
  strftime(visit_date, '%Y-%m-%d') AS visit_date, CAST(CAST(attendees AS BIGINT) AS VARCHAR) AS head_count,
  CAST(CAST(capacity AS BIGINT) AS VARCHAR) AS seats, CAST(l_orderkey AS VARCHAR) AS note, 'one too many' AS spare
FROM visits WHERE l_linenumber = 3""")
def q_quarantine_records(spark, sf):
    """The records left out of an export whose visits of line 3 have a field too many."""
    path = _export(spark, sf, first_rows=0, spoil_line=3)
    bad = cl.clean_table(spark, path, on_bad="quarantine").quarantined
    names = {"site": 0, "visit_date": 1, "head_count": 2, "seats": 3, "note": 4, "spare": 6}
    return bad.select("reason", *[F.col("cells")[k].alias(n) for n, k in names.items()])


@register("clean_table_quarantine", _CLEAN.replace("(4, 7)", "(3, 4, 7)"))
def q_clean_table_quarantine(spark, sf):
    """The clean table of that export."""
    path = _export(spark, sf, first_rows=0, spoil_line=3)
    return rounded(cl.clean_table(spark, path, on_bad="quarantine").table)


@register("clean_report", """SELECT count(*) + 3 AS rows_before,
  count(*) FILTER (WHERE l_linenumber NOT IN (4, 7)) AS rows_after,
  count(*) + 3 - count(*) FILTER (WHERE l_linenumber NOT IN (4, 7)) AS removed FROM visits""")
def q_clean_report(spark, sf):
    return cl.clean_table(spark, _export(spark, sf)).report()


@register("sink_summary", _MONTHLY)
def q_sink_summary(spark, sf):
    s = mo.monthly_summary(view(spark, sf), "building", "visit_date", ["attendees", "capacity"])
    path = scratch_dir(spark, "summary")
    sinks.write_summary(s, path, "csv")
    return rounded(spark.read.schema(s.schema).option("header", True).csv(path))


@register("sink_by_group", f"""SELECT *, replace(building, ' ', '_') AS group_slug
FROM ({_MONTHLY})""")
def q_sink_by_group(spark, sf):
    s = mo.monthly_summary(view(spark, sf), "building", "visit_date", ["attendees", "capacity"])
    path = scratch_dir(spark, "by-group")
    sinks.write_by_group(s, path, "building")
    back = spark.read.parquet(path)
    return rounded(back.withColumn("group_slug", F.col("group_slug").cast("string")))


# -- P1-P7 as separate steps over the same export ------------------------------------
def _steps(spark, sf):
    path = _export(spark, sf)
    st = ci.analyze_structure(spark, path)
    body = ci.null_tokens(ci.scan_csv_header_offset(spark, path, st.preview,
                                                    st.header_row_index, st.header, records=st.records,
                                                    ends=st.ends))
    return st, cl.rename_canonical(body, st.column_mappings)


_RENAMED = f"""SELECT "Site" AS "Building Name", "Visit date" AS "Date",
  "Head count" AS "Attendees", "Seats" AS "Capacity", "Note", "Guest ""remark""\" FROM (
  SELECT "Site", "Visit date",
         CASE WHEN "Head count" = 'N/A' THEN NULL ELSE "Head count" END AS "Head count",
         "Seats", "Note", "Guest ""remark""\" FROM ({_BODY}))"""


@register("rename_canonical", _RENAMED)
def q_rename_canonical(spark, sf):
    return _steps(spark, sf)[1]


_NONEMPTY = f"""SELECT * FROM ({_RENAMED}) WHERE NOT ("Building Name" IS NULL AND "Date" IS NULL
  AND "Attendees" IS NULL AND "Capacity" IS NULL AND "Note" IS NULL
  AND "Guest ""remark""\" IS NULL)"""


@register("drop_all_null", _NONEMPTY)
def q_drop_all_null(spark, sf):
    return cl.drop_all_null(_steps(spark, sf)[1])


@register("drop_repeated_headers", f"""SELECT * FROM ({_NONEMPTY}) WHERE NOT coalesce(
  lower(trim("Building Name")) = 'building name' OR lower(trim("Date")) = 'date'
  OR lower(trim("Attendees")) = 'attendees' OR lower(trim("Capacity")) = 'capacity'
  OR lower(trim("Note")) = 'note' OR lower(trim("Guest ""remark""\")) = 'guest "remark"', false)""")
def q_drop_repeated_headers(spark, sf):
    return cl.drop_repeated_headers(cl.drop_all_null(_steps(spark, sf)[1]))


_TYPED = f"""SELECT "Building Name",
  CAST(try_strptime(trim("Date"), '%Y-%m-%d') AS TIMESTAMP) AS "Date",
  CASE WHEN regexp_matches("Attendees", '[0-9.][dDfF]\\s*$') THEN NULL
       ELSE TRY_CAST(trim("Attendees") AS DOUBLE) END AS "Attendees",
  CASE WHEN regexp_matches("Capacity", '[0-9.][dDfF]\\s*$') THEN NULL
       ELSE TRY_CAST(trim("Capacity") AS DOUBLE) END AS "Capacity", "Note", "Guest ""remark""\"
FROM ({_NONEMPTY})"""


@register("coerce_date", f"""SELECT "Building Name", "Date" FROM ({_TYPED})""")
def q_coerce_date(spark, sf):
    st, df = _steps(spark, sf)
    fmt = st.profile[st.column_mappings["date"]]["date_format"]
    return cl.coerce_date(cl.drop_all_null(df), "Date", fmt).select("Building Name", "Date")


@register("coerce_numeric", f"""SELECT "Building Name", "Attendees", "Capacity" FROM ({_TYPED})""")
def q_coerce_numeric(spark, sf):
    df = cl.coerce_numeric_columns(cl.drop_all_null(_steps(spark, sf)[1]))
    return rounded(df.select("Building Name", "Attendees", "Capacity"))


@register("drop_critical_null", f"""SELECT * FROM ({_TYPED}) WHERE "Building Name" IS NOT NULL
  AND "Date" IS NOT NULL AND "Attendees" IS NOT NULL AND "Capacity" IS NOT NULL""")
def q_drop_critical_null(spark, sf):
    st, df = _steps(spark, sf)
    fmt = st.profile[st.column_mappings["date"]]["date_format"]
    typed = cl.coerce_numeric_columns(cl.coerce_date(cl.drop_all_null(df), "Date", fmt))
    return rounded(cl.drop_critical_null(typed))
