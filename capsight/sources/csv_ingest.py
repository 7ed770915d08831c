"""Messy CSV ingestion: preview, header and role detection, header-offset scan.

* S2 ``preview_raw``: the first 10 non-blank records of the first file by
  name (a constant-size sample, the only lines that reach the driver).
* S4 ``detect_header``: a deterministic score per preview row in place of
  the reference's remote model call: a header row is filled, textual,
  unique, and sits above rows whose cells are numbers or dates.
* S5 ``detect_roles``: the best joint assignment of columns to roles, from
  names and from one profile of all values (numeric rate, date rate,
  distinct values, mean).
* S1 ``read_records`` and ``scan_csv_header_offset``: Spark parses all files
  once with an all-string schema (splittable, any number of files) and writes
  the records with their place (file, split, running id), so that every later
  step means the same record by the same id, however files are split then.
  Each file's header is looked for in its own first records: what stands
  above and on it is dropped by its place, and its columns are put in the
  first file's order by name. A header of other words, or a record with more
  fields than the header, is an error, or goes to :func:`quarantine` with its
  place and reason where a function is called with ``on_bad="quarantine"``.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.exprs import DATE_FORMATS, INTEGER_TEXT, NA_TOKENS, NUMERIC_TEXT, computed_once, iso_day, parse_date
from capsight.functions.joins import join_small, materialize, stage

PREVIEW_ROWS = 10

# Words that name a role (this library's own lists). A strong word says the
# role by itself; a weak one ("total", "max", "size") goes with either count.
STRONG = {
    "building_name": r"build|location|site|facility|venue|office|branch|room|place|hall|geb(ä|ae)ude|"
                     r"standort|b(â|a)timent|lieu|edificio|lugar|sede",
    "date": r"date|day|datum|tag\b|fecha|d(í|i)a\b|jour|timestamp",
    "attendees": r"attend|visitor|people|person|head ?count|guest|participant|present|occupan|besucher|"
                 r"teilnehm|g(ä|ae)ste|visiteur|asistent|visitant|invitad",
    "capacity": r"capaci|kapazit|seat|pl(ä|ae)tze|sitze|places? assises|aforo|asientos|limit",
}
WEAK = {
    "building_name": r"name|unit|area",
    "date": r"time|period|when|zeit|hora",
    "attendees": r"count|total|number|anzahl|nombre|n(ú|u)mero|used",
    "capacity": r"max|space|size|total|avail",
}
ROLES = ("building_name", "date", "attendees", "capacity")
CANONICAL = {"building_name": "Building Name", "date": "Date", "attendees": "Attendees",
             "capacity": "Capacity"}
# A role needs this score; the two counts are told apart by at least this margin.
MIN_SCORE, MIN_MARGIN = 0.6, 0.1
# Shapes of date text and the formats worth trying on a column that shows them;
# a text has one shape at most, and no number has any.
DATE_SHAPES = {
    r"^\s*\d{4}-\d{1,2}-\d{1,2}": [f for f in DATE_FORMATS if f.startswith("yyyy-")],
    r"^\s*\d{4}/": ["yyyy/M/d"],
    r"^\s*\d{1,2}/\d{1,2}/": [f for f in DATE_FORMATS if "/" in f and not f.startswith("y")],
    r"^\s*\d{1,2}-\d{1,2}-\d{4}": ["d-M-yyyy", "M-d-yyyy"],
    r"^\s*\d{1,2}\.\d{1,2}\.": ["d.M.yyyy"],
    r"^\s*([A-Za-z]{3,9}\.? \d|\d{1,2} [A-Za-z])": [f for f in DATE_FORMATS if "MMM" in f],
}
ISO_DAY = "yyyy-MM-dd"  # of the first shape
# How text of any of these shapes starts.
DATE_START = r"^\s*(\d{1,4}[-/.]|\d{1,2} [A-Za-z]|[A-Za-z]{3,9}\.? \d)"

_NUM = re.compile(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$")
_DATE = re.compile(r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|"
                   r"\d{1,2} [A-Za-z]{3,9} \d{4})([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$")


@dataclass
class Structure:
    """One-row description of a file: header row, role mapping, confidence."""
    header_row_index: int
    header: list[str]
    column_mappings: dict[str, str | None] = field(default_factory=dict)
    confidence: float = 0.0
    notes: str = ""
    width: int = 0
    preview: list[list[str | None]] = field(default_factory=list)
    profile: dict[str, dict] = field(default_factory=dict)
    records: DataFrame | None = None  # see read_records
    ends: DataFrame | None = None  # see file_headers
    on_bad: str = "raise"

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = ("header_row_index INT, column_mappings MAP<STRING,STRING>, "
                  "confidence DOUBLE, notes STRING")
        return spark.createDataFrame([(self.header_row_index, self.column_mappings,
                                       float(self.confidence), self.notes)], schema)


def _reader(spark: SparkSession, multiline: bool):
    """CSV options of every read: a quote inside a quoted cell is doubled;
    with ``multiline`` a quoted cell may hold line breaks (such files are not
    split). An absent cell is told from an empty one by ``nullValue``."""
    return (spark.read.option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multiline)
            .option("nullValue", _ABSENT).option("emptyValue", ""))


_ABSENT = "\u0001"


def preview_raw(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS,
                multiline: bool = False) -> list[list[str | None]]:
    """The first ``rows`` non-blank records of the first file by name, as
    lists of fields ('' -> None), padded to the widest."""
    files = sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    recs: list[list[str]] = []
    for file in files:
        lines = (spark.read.text(file).where(F.trim(F.col("value")) != "")
                 .limit(rows * (20 if multiline else 1)).collect())
        text = "\n".join(r.value for r in lines)
        recs = [r for r in csv.reader(io.StringIO(text))] if multiline else \
               [next(csv.reader(io.StringIO(r.value))) for r in lines]
        if recs:
            break
    recs = recs[:rows]
    width = max((len(r) for r in recs), default=0)
    return [[(v if v != "" else None) for v in r] + [None] * (width - len(r)) for r in recs]


def _kind(v: str | None) -> str:
    if v is None or v.strip() == "" or v.strip() in NA_TOKENS:
        return "empty"
    if _NUM.match(v.replace(",", "")):
        return "number"
    if _DATE.match(v):
        return "date"
    return "text"


def detect_header(preview: list[list[str | None]]) -> tuple[int, float, str]:
    """Index of the header among the preview rows, a confidence in
    [0, 1] and a note. Ties go to the earlier row."""
    best, best_score = 0, 0.0
    for i, row in enumerate(preview):
        kinds = [_kind(v) for v in row]
        filled = [k for k in kinds if k != "empty"]
        if len(filled) < 2:
            continue
        texty = sum(k == "text" for k in filled) / len(filled)
        vals = [v.strip().lower() for v, k in zip(row, kinds) if k != "empty"]
        unique = len(set(vals)) / len(vals)
        below = preview[i + 1:i + 4]
        turns = 0
        for j, k in enumerate(kinds):
            if k != "text" or not below:
                continue
            under = [_kind(r[j]) for r in below if j < len(r)]
            if under and sum(u in ("number", "date") for u in under) * 2 >= len(under):
                turns += 1
        type_change = turns / len(filled)
        score = (len(filled) / len(row)) * texty * unique * (0.5 + 0.5 * type_change)
        if score > best_score + 1e-12:
            best, best_score = i, score
    note = (f"row {best} chosen: filled, textual and unique cells above typed rows"
            if best_score > 0 else "no header-like row found; using row 0")
    return best, round(best_score, 4), note


def header_names(preview: list[list[str | None]], index: int) -> list[str]:
    """Names of the header row: blank -> 'Unnamed: k', repeats -> 'x.1', 'x.2'."""
    raw = preview[index] if preview else []
    names, seen = [], {}
    for k, v in enumerate(raw):
        n = v.strip() if v and v.strip() else f"Unnamed: {k}"
        if n in seen:
            seen[n] += 1
            n = f"{n}.{seen[n]}"
        else:
            seen[n] = 0
        names.append(n)
    return names


def _header_of(preview, header_row: int) -> list[str | None]:
    header = list(preview[header_row]) if preview else []
    while header and header[-1] is None:
        header.pop()
    return header


def read_records(spark: SparkSession, path: str, width: int, multiline: bool = False) -> DataFrame:
    """All records under ``path``, parsed once and written to the shared
    checkpoint folder: ``_c0`` .. ``_c<width>`` (one more than the header has),
    ``_file``, ``_start`` (first byte of the record's split) and ``_row_id``,
    which rises in line order within a split. One more column is declared and
    not read: when columns are selected the parser fills up short records, else
    each one is an exception within the reader."""
    cells = [f"_c{k}" for k in range(width + 1)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_unread"]])
    raw = (_reader(spark, multiline).option("recursiveFileLookup", True).schema(schema).csv(path)
           .select(*cells, F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_start"))
           .withColumn("_row_id", F.monotonically_increasing_id()))
    return stage(raw, raw.columns, "records")


def _check_mode(on_bad: str) -> None:
    if on_bad not in ("raise", "quarantine"):
        raise ValueError(f"on_bad is 'raise' or 'quarantine', not {on_bad!r}")


def file_headers(records: DataFrame, header: list[str | None], on_bad: str = "raise") -> DataFrame:
    """(_file, _first, _end, _pos, _strange): per file with a header the ids of
    its first record and of its header, which is the first of its PREVIEW_ROWS
    first records that holds the words of ``header`` in any order, and the place
    of each of these words in it. A file none of whose first records does is left
    out (its records are read by position); if one looks like a header of other
    words, with text alone above a record of numbers or dates, ValueError names
    the file, or with ``on_bad="quarantine"`` the file is ``_strange``."""
    _check_mode(on_bad)
    width = len(header)
    head = records.where("_start = 0")
    first = head.groupBy("_file").agg(F.min("_row_id").alias("_first"))
    near = join_small(head, first, "_file").where(F.col("_row_id") < F.col("_first") + PREVIEW_ROWS)
    cells = F.array(*[F.nullif(F.col(f"_c{k}"), F.lit("")) for k in range(width)])
    want = F.array(*[F.lit(v).cast("string") for v in header])
    filled = F.filter(cells, lambda x: x.isNotNull())
    typed = F.filter(filled, lambda x: F.regexp_replace(x, ",", "").rlike(_NUM.pattern) | x.rlike(_DATE.pattern))
    here = near.select("_file", "_first", "_row_id", cells.alias("_cells"), F.col(f"_c{width}").alias("_over"),
                       F.size(filled).alias("_filled"), F.size(typed).alias("_typed"), F.size(F.array_distinct(filled)).alias("_words"))
    same = F.array_sort("_cells").eqNullSafe(F.array_sort(want)) & F.col("_over").isNull()
    words = F.col("_filled") * (F.col("_filled") >= F.greatest(F.lit(2), F.lit(width) - 1)).cast("int")
    other = (words > 0) & (F.col("_typed") == 0) & (F.col("_words") == F.col("_filled"))
    # in a header with a repeated word its places count only where the order is the same
    place = F.transform(want, lambda w: (F.array_position("_cells", w) - 1).cast("int"))
    straight = F.array(*[F.lit(k) for k in range(width)])
    pos = F.when(F.col("_cells").eqNullSafe(want) | F.lit(len(set(header)) < width), straight).otherwise(place)
    found = materialize(here.groupBy("_file").agg(
        F.first("_first").alias("_first"), F.min(F.when(same, F.col("_row_id"))).alias("_end"),
        F.min_by(F.when(same, pos), F.when(same, F.col("_row_id"))).alias("_pos"),
        F.min(F.when(other, F.col("_row_id"))).alias("_odd"), F.max(F.when(F.col("_typed") > 0, F.col("_row_id"))).alias("_data")))
    strange = F.expr("_end is null and coalesce(_odd < _data, false)")
    if on_bad == "raise":
        names = [r["_file"] for r in found.where(strange).orderBy("_file").limit(5).collect()]
        if names:
            raise ValueError(f"header with other columns than {header} in {', '.join(names)}")
    return found.where(F.col("_end").isNotNull() | strange).select("_file", "_first", "_end", "_pos", strange.alias("_strange"))


def _placed(records: DataFrame, ends: DataFrame) -> tuple[DataFrame, F.Column]:
    """The records beside their file's header, and whether one stands above or on it."""
    above = (F.col("_start") == 0) & (F.col("_row_id") >= F.col("_first")) & (F.col("_row_id") <= F.col("_end"))
    return join_small(records, ends, "_file", "left", materialized=True), F.coalesce(above, F.lit(False))


def quarantine(records: DataFrame, header: list[str | None], ends: DataFrame | None = None) -> DataFrame:
    """The records that :func:`scan_csv_header_offset` leaves out with
    ``on_bad="quarantine"``: (file, split_start, row_id, reason, cells). Cells
    are the record's first fields, one more than the header has."""
    width = len(header)
    if ends is None:
        ends = file_headers(records, header, "quarantine")
    body, above = _placed(records, ends)
    reason = F.when(F.col("_strange"), F.lit("header with other columns")).when(
        F.col(f"_c{width}").isNotNull(), F.lit(f"more than {width} fields"))
    return (body.where(~above).withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select(F.col("_file").alias("file"), F.col("_start").alias("split_start"), F.col("_row_id").alias("row_id"),
                    "reason", F.array(*[F.col(f"_c{k}") for k in range(width + 1)]).alias("cells")))


def scan_csv_header_offset(spark: SparkSession, path: str, preview: list[list[str | None]],
                           header_row: int, names: list[str] | None = None,
                           row_id: bool = False, multiline: bool = False, records: DataFrame | None = None,
                           ends: DataFrame | None = None, on_bad: str = "raise") -> DataFrame:
    """All files under ``path``. In each file the records up to and with
    its header (the words of record ``header_row`` of the preview in any order,
    looked for among the file's first records) are dropped by their place; an
    equal record further down stays. Columns are named by the first file's
    header and read by name in every file that has one, by position in others.
    A record with more fields than the header raises when it is read, as the
    reference's reader does, and with ``on_bad="quarantine"`` it is left to
    :func:`quarantine`; a shorter one is filled with NULL.

    ``row_id`` adds ``_row_id``: increasing in line order within each split,
    splits numbered in the order the scan packs them (for one file, plain
    file order). ``records`` and ``ends`` pass what :func:`read_records` and
    :func:`file_headers` returned."""
    _check_mode(on_bad)
    header = _header_of(preview, header_row)
    width = len(header)
    names = (names or header_names(preview, header_row))[:width]
    if records is None:
        records = read_records(spark, path, width, multiline)
    if ends is None:
        ends = file_headers(records, header, on_bad)
    body, above = _placed(records, ends)
    over = F.raise_error(F.concat(F.lit(f"expected {width} fields, found more in "), F.col("_file"),
                                  F.lit(": "), F.concat_ws(",", *[f"_c{k}" for k in range(width + 1)])))
    # what stands above a header is no record of the table, whatever its width
    bad = over.cast("boolean") if on_bad == "raise" else F.lit(False)
    keep = F.when(above | F.coalesce(F.col("_strange"), F.lit(False)), F.lit(False)).when(
        F.col(f"_c{width}").isNull(), F.lit(True)).otherwise(bad)
    straight = F.array(*[F.lit(k) for k in range(width)])
    if ends.where(F.col("_pos") != straight).limit(1).count():
        cells = F.array(*[F.col(f"_c{k}") for k in range(width)])
        value = [F.get(cells, F.coalesce(F.get("_pos", F.lit(k)), F.lit(k))) for k in range(width)]
    else:
        value = [F.col(f"_c{k}") for k in range(width)]
    extra = ["_row_id"] if row_id else []
    return body.where(keep).select(*[F.nullif(v, F.lit("")).alias(n) for v, n in zip(value, names, strict=True)], *extra)


def null_tokens(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """S3: missing-value tokens of a CSV reader (``NA``, ``N/A``, ``null`` ...) -> NULL."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return computed_once(df, {c: F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")) for c in cols})


def cell_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_i, _s, _n): each different text ``_s`` of the ``_i``-th of ``cols`` and
    how many rows hold it. One row a cell goes in, so that code which tests a
    text is as small for any number of columns."""
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in cols])).alias("_i", "_s"))
    return cells.where("_s IS NOT NULL").groupBy("_i", "_s").agg(F.count("_s").alias("_n"))


def profile_strings(df: DataFrame) -> dict[str, dict[str, float]]:
    """Per column of an all-string table the non-null count, numeric and
    integer parse rates, mean, distinct count, best date format
    and its parse rate. One pass over all rows, and one a column if date formats
    have to be tried on it: only those whose shape of text the first saw there,
    and none for plain ISO days, which the first counts. Equal cells of a column
    are counted first, so each different text is tested once.
    """
    cols = df.columns
    if not cols:
        return {}
    cells = cell_counts(df, cols)
    s, kind = F.col("_s"), F.col("_kind")
    rows = lambda cond: F.sum(F.when(cond, F.col("_n")))
    # 2 an integer, 1 another number, -1, -2 ... the shapes of dates, 0 other
    # text; text that does not start as a date has none of the shapes
    test = F.when(s.rlike(INTEGER_TEXT), 2).when(s.rlike(NUMERIC_TEXT), 1).when(~s.rlike(DATE_START), 0)
    for j, shape in enumerate(DATE_SHAPES):
        test = test.when(s.rlike(shape), -1 - j)
    num, iso = F.when(kind > 0, s.try_cast("double")), kind == -1
    tested = cells.withColumn("_kind", test.otherwise(0)).select("_i", "_s", "_n", "_kind", num.alias("_num"))
    number = F.col("_num").isNotNull()
    finite = F.abs("_num") < F.lit(float("inf"))
    seen = tested.groupBy("_i").agg(
        F.sum("_n").alias("n"), rows(number).alias("num"),
        F.try_divide(F.sum(F.when(finite, F.col("_num") * F.col("_n"))), rows(finite)).alias("m"),
        rows(kind == 2).alias("int"), F.count(s).alias("d"),
        F.bit_or(F.when(kind < 0, F.expr("shiftleft(1, -1 - _kind)"))).alias("shapes"),
        F.count_if((iso & ~iso_day(s)) | ((kind == 0) & F.substring(F.btrim(s), 1, 1).isin("+", "-"))).alias("rest"),
        rows(iso & iso_day(s) & parse_date(s, ISO_DAY).isNotNull()).alias("day")).collect()
    r = {f"{k}{i}": 0 for i in range(len(cols)) for k in ("n", "num", "int", "d", "shapes", "rest", "day")}
    r |= {f"m{i}": None for i in range(len(cols))}
    r |= {f"{k}{x['_i']}": v for x in seen for k, v in x.asDict().items() if v is not None}
    tries = {}
    for i in range(len(cols)):
        shown = [j for j in range(len(DATE_SHAPES)) if r[f"shapes{i}"] >> j & 1]
        if 0 in shown and not r[f"rest{i}"]:  # of the ISO formats only plain days, which are counted
            r[f"dt{i}_{DATE_FORMATS.index(ISO_DAY)}"] = r[f"day{i}"]
            shown.remove(0)
        tries[i] = [f for j in shown for f in list(DATE_SHAPES.values())[j]]
    for i, fs in tries.items():
        if fs:
            r |= cell_counts(df, [cols[i]]).agg(*[rows(parse_date(s, f).isNotNull()).alias(f"dt{i}_{DATE_FORMATS.index(f)}")
                                                  for f in fs]).first().asDict()
    out = {}
    for i, c in enumerate(cols):
        n = r[f"n{i}"] or 0
        rates = [(r.get(f"dt{i}_{j}") or 0) for j in range(len(DATE_FORMATS))]
        best = max(range(len(rates)), key=lambda j: (rates[j], -j))
        out[c] = {"n": n, "numeric": (r[f"num{i}"] / n) if n else 0.0,
                  "integer": (r[f"int{i}"] / n) if n else 0.0, "mean": r[f"m{i}"],
                  "date": (rates[best] / n) if n else 0.0, "date_format": DATE_FORMATS[best],
                  "distinct": r[f"d{i}"]}
    return out


_NOTHING = {"n": 0, "numeric": 0.0, "date": 0.0, "distinct": 0, "mean": None}


def _role_score(role: str, name: str, p: dict) -> float:
    """Name evidence (1 strong, 0.3 weak) plus how well the values fit."""
    hit = 1.0 if re.search(STRONG[role], name, re.I) else 0.3 if re.search(WEAK[role], name, re.I) else 0.0
    if role == "date":
        return hit + p["date"]
    if role in ("attendees", "capacity"):
        return hit + p["numeric"] * (1.0 - p["date"])
    text = max(0.0, 1.0 - p["numeric"] - p["date"])
    return hit + text * (1.0 if p["n"] == 0 else max(0.0, 1.0 - p["distinct"] / max(p["n"], 1)))


def _pair_score(a: dict, c: dict) -> float:
    """Evidence of the values that ``c`` is the capacity of ``a``: a capacity
    has fewer distinct values, and its mean is not below the attendance."""
    if a.get("mean") is None or c.get("mean") is None:
        return 0.0
    fewer = 0.25 if c["distinct"] < a["distinct"] else -0.25 if c["distinct"] > a["distinct"] else 0.0
    larger = 0.25 if c["mean"] > a["mean"] else -0.25 if c["mean"] < a["mean"] else 0.0
    return fewer + larger


def detect_roles(names: list[str], prof: dict[str, dict]) -> tuple[dict[str, str | None], float]:
    """Map the four roles to columns from names and value profile.

    All assignments of different columns to roles are compared (each role
    with its six best columns), so that a word that fits two roles does not
    decide by the order of the roles or of the columns. When exchanging
    attendees and capacity scores almost as well, the columns do not tell:
    ValueError names both."""
    p = {c: prof.get(c, _NOTHING) for c in names}
    options = {}
    for role in ROLES:
        scored = sorted(((_role_score(role, c, p[c]), -i, c) for i, c in enumerate(names)), reverse=True)[:6]
        options[role] = [(s, c) for s, _, c in scored if s >= MIN_SCORE] + [(0.0, None)]
    best, best_s = dict.fromkeys(ROLES), -1.0
    totals = {}
    for combo in itertools.product(*(options[r] for r in ROLES)):
        cols = [c for _, c in combo if c is not None]
        if len(set(cols)) < len(cols):
            continue
        total = sum(s for s, _ in combo)
        att, cap = combo[2][1], combo[3][1]
        if att and cap:
            total += _pair_score(p[att], p[cap])
        totals[tuple(c for _, c in combo)] = total
        if total > best_s + 1e-9:
            best, best_s = {r: c for r, (_, c) in zip(ROLES, combo)}, total
    att, cap = best["attendees"], best["capacity"]
    if att and cap:
        swapped = totals.get((best["building_name"], best["date"], cap, att), 0.0)
        if best_s - swapped < MIN_MARGIN:
            raise ValueError(f"cannot tell attendees from capacity; candidates: {att!r} and {cap!r}")
    scores = [min(_role_score(r, c, p[c]) / 2.0, 1.0) if c else 0.0 for r, c in best.items()]
    return best, sum(scores) / len(scores)


def analyze_structure(spark: SparkSession, path: str, multiline: bool = False, on_bad: str = "raise") -> Structure:
    """S4 + S5 on a file or folder: preview, header row, role mapping."""
    prev = preview_raw(spark, path, multiline=multiline)
    if not prev:
        raise ValueError(f"no data found in {path}")
    idx, conf, note = detect_header(prev)
    names = header_names(prev, idx)
    header = _header_of(prev, idx)
    records = read_records(spark, path, len(header), multiline)
    ends = file_headers(records, header, on_bad)
    body = null_tokens(scan_csv_header_offset(spark, path, prev, idx, names, records=records, ends=ends, on_bad=on_bad))
    names = body.columns
    prof = profile_strings(body)
    mapping, rconf = detect_roles(names, prof)
    return Structure(idx, names, mapping, round((conf + rconf) / 2, 4), note, len(names), prev,
                     prof, records, ends, on_bad)
