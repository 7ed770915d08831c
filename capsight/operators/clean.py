"""Cleaning chain (P1-P9, S9): rename, drop empty and repeated-header rows,
check required columns, coerce types, drop incomplete rows, report.

Every step is a lazy column expression or filter in the scan stage, and each
cell is computed once (:func:`capsight.functions.exprs.computed_once`), not again
by every later filter. Only :func:`load_table` acts (it must report an
empty result as an error, as the reference's loader does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.exprs import DATE_FORMATS, coerce_numeric, computed_once, parse_date
from capsight.sources import csv_ingest as ci

REQUIRED = ["Building Name", "Date", "Attendees", "Capacity"]
# Characters stripped around a cell before the repeated-header test.
WHITESPACE = " \t\n\r\f\v"


def rename_canonical(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Source column -> canonical name for each mapped role; names not
    in the table are ignored; two sources for one name are rejected."""
    ren = {src: ci.CANONICAL[role] for role, src in mapping.items() if src}
    targets = list(ren.values())
    if len(set(targets)) != len(targets):
        raise ValueError(f"two columns map to one canonical name: {ren}")
    return df.withColumnsRenamed({k: v for k, v in ren.items() if k in df.columns})


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop rows whose every cell is NULL."""
    return df.na.drop(how="all")


def may_equal(cell: Column, name: str) -> Column:
    """A cheap test before ``cell`` is trimmed: whether it is as long as
    ``name`` (in lower case) and holds it. True of every cell that equals the
    name then; one letter can be two in lower case, a dotted I."""
    return (F.length(cell) >= len(name.replace("i\u0307", "i"))) & F.contains(F.lower(cell), F.lit(name))


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Drop rows where any non-NULL cell equals its own column name,
    ignoring case and surrounding whitespace."""
    hit = F.lit(False)
    for c in df.columns:
        cell, name = F.col(f"`{c}`").cast("string"), c.strip().lower()
        same = may_equal(cell, name) & (F.lower(F.btrim(cell, F.lit(WHITESPACE))) == F.lit(name))
        hit = hit | F.coalesce(same, F.lit(False))
    return df.where(~hit)


def require_columns(df: DataFrame, required: list[str] = REQUIRED, notes: str = "") -> DataFrame:
    """Raise when a required column is missing (lists missing and found)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"could not identify all required columns. Missing: "
                         f"{', '.join(missing)}. Found: {', '.join(df.columns)}. Notes: {notes}")
    return df


def choose_date_format(df: DataFrame, column: str) -> str:
    """Q3: the candidate format with the highest parse rate (one aggregate
    job); ties go to the earlier candidate (ISO, then month-first)."""
    s = F.col(f"`{column}`")
    r = df.agg(*[F.count(parse_date(s, f)).alias(f"f{i}")
                 for i, f in enumerate(DATE_FORMATS)]).first()
    best = max(range(len(DATE_FORMATS)), key=lambda i: (r[f"f{i}"] or 0, -i))
    return DATE_FORMATS[best]


def coerce_date(df: DataFrame, column: str = "Date", fmt: str | None = None) -> DataFrame:
    """P5: text -> timestamp with the chosen format; unparsable -> NULL.
    Columns that already hold timestamps or dates are kept."""
    t = df.schema[column].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(t, T.DateType):
        return df.withColumn(column, F.col(f"`{column}`").cast("timestamp_ntz"))
    fmt = fmt or choose_date_format(df, column)
    return computed_once(df, {column: parse_date(F.col(f"`{column}`"), fmt)})


def coerce_numeric_columns(df: DataFrame, cols: list[str] = ("Attendees", "Capacity")) -> DataFrame:
    """Text -> double with to_numeric(errors='coerce') rules."""
    return computed_once(df, {c: coerce_numeric(F.col(f"`{c}`")) for c in cols
                              if isinstance(df.schema[c].dataType, T.StringType)})


def drop_critical_null(df: DataFrame, cols: list[str] = REQUIRED) -> DataFrame:
    """Drop rows with any of the critical columns NULL."""
    return df.na.drop(how="any", subset=list(cols))


def clean_report(before: DataFrame, cols: list[str] = REQUIRED) -> DataFrame:
    """Rows before and after the critical-NULL drop, and the difference,
    from one aggregate over the pre-drop frame."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return before.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(ok).alias("rows_after")) \
                 .withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def infer_other_types(df: DataFrame, prof: dict[str, dict], skip: list[str]) -> DataFrame:
    """Columns outside the four roles keep an inferred type: all values
    integers -> BIGINT, all numeric -> DOUBLE, else text."""
    casts = {}
    for c in df.columns:
        p = prof.get(c)
        if c in skip or not p or p["n"] == 0 or not isinstance(df.schema[c].dataType,
                                                                 T.StringType):
            continue
        if p["integer"] == 1.0:
            casts[c] = F.btrim(F.col(f"`{c}`")).try_cast("long")
        elif p["numeric"] == 1.0:
            casts[c] = coerce_numeric(F.col(f"`{c}`"))
    return df.withColumns(casts)


@dataclass
class Cleaned:
    table: DataFrame          # the typed, clean table (lazy)
    before_drop: DataFrame    # the frame P8 counts from (lazy)
    structure: ci.Structure
    quarantined: DataFrame | None = None  # records left out (lazy), see csv_ingest.quarantine

    def report(self) -> DataFrame:
        return clean_report(self.before_drop)


def clean_table(spark: SparkSession, path: str, structure: ci.Structure | None = None,
                row_id: bool = False, multiline: bool = False, on_bad: str = "raise") -> Cleaned:
    """S2 -> S4/S5 -> S1 -> S3 -> P1 -> P2 -> P3 -> P4 -> P5/P6 -> P7.

    ``row_id=True`` keeps a ``_row_id`` column in line order (see
    :func:`capsight.sources.csv_ingest.scan_csv_header_offset`), usable as
    the tie-break key when file-order behaviour is wanted. ``on_bad`` (or that
    of the ``structure`` passed) says whether a bad record raises or goes to
    ``quarantined``."""
    st = structure or ci.analyze_structure(spark, path, multiline, on_bad)
    body = ci.null_tokens(ci.scan_csv_header_offset(spark, path, st.preview, st.header_row_index,
                                                    st.header, row_id=row_id,
                                                    multiline=multiline, records=st.records,
                                                    ends=st.ends, on_bad=st.on_bad))
    renamed = rename_canonical(body, st.column_mappings)
    step = drop_repeated_headers(drop_all_null(renamed))
    require_columns(step, REQUIRED, st.notes)
    prof = st.profile or ci.profile_strings(body)
    date_src = st.column_mappings.get("date")
    fmt = prof[date_src]["date_format"] if date_src in prof else None
    typed = coerce_numeric_columns(coerce_date(step, "Date", fmt))
    src_by_name = {c: c for c in body.columns if c != "_row_id"}
    for role, src in st.column_mappings.items():
        if src:
            src_by_name[ci.CANONICAL[role]] = src
    prof_renamed = {c: prof[src_by_name[c]] for c in typed.columns if src_by_name.get(c) in prof}
    typed = infer_other_types(typed, prof_renamed, REQUIRED + ["_row_id"])
    bad = None
    if st.on_bad == "quarantine" and st.records is not None:
        bad = ci.quarantine(st.records, st.preview[st.header_row_index][:st.width], st.ends)
    return Cleaned(drop_critical_null(typed), typed, st, bad)


def load_table(spark: SparkSession, path: str, row_id: bool = False,
               multiline: bool = False, quarantine_path: str | None = None) -> DataFrame:
    """The clean table, or ValueError with the reason (never a silent
    fallback). Counts once to reject an empty result. A bad record (more
    fields than the header, a file under another header) is such a reason,
    unless ``quarantine_path`` names a folder: then all bad records are
    written there as Parquet with file, place and reason before the table is
    returned, so none is lost unseen."""
    on_bad = "quarantine" if quarantine_path else "raise"
    try:
        c = clean_table(spark, path, row_id=row_id, multiline=multiline, on_bad=on_bad)
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001 - re-raised with the loader's message
        raise ValueError(f"error loading file: {e}") from e
    if c.quarantined is not None:
        c.quarantined.write.mode("overwrite").parquet(quarantine_path)
    if c.table.limit(1).count() == 0:
        raise ValueError("no valid data rows found after cleaning")
    return c.table
