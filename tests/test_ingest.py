"""Messy CSV ingestion (S1-S5, S9, P1-P9) on small generated files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from capsight.operators import clean as cl
from capsight.sources import csv_ingest as ci
from capsight.sources import messy, sinks

TITLE = ["Visitor report 2024", "Generated for all sites", ""]
HEADER = "Site,Visit date,Head count,Seats,Note"
BODY = [
    "North Hall,2024-01-02,12,50,ok",
    "North Hall,2024-01-03,N/A,50,missing count",
    'North Hall,2024-01-04,"1,234",50,thousands',
    "South Hall,2024-01-02, 12 ,40,padded",
    "South Hall,2024-01-03,1d,40,suffix",
    "South Hall,2024-02-30,10,40,bad date",
    HEADER,
    ",,,,",
    "East Wing,2024-01-05,30,30,full",
    "East Wing,2024-01-06,45,30,over",
    "East Wing,2024-01-07,0,0,zero cap",
    "West Wing,2024-01-08,5,,no seats",
]
EXPECTED = {("North Hall", dt.datetime(2024, 1, 2), 12.0, 50.0),
            ("South Hall", dt.datetime(2024, 1, 2), 12.0, 40.0),
            ("East Wing", dt.datetime(2024, 1, 5), 30.0, 30.0),
            ("East Wing", dt.datetime(2024, 1, 6), 45.0, 30.0),
            ("East Wing", dt.datetime(2024, 1, 7), 0.0, 0.0)}


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def rows(df):
    return {(r["Building Name"], r["Date"], r["Attendees"], r["Capacity"]) for r in df.collect()}


def test_structure_detection(spark, tmp_dir):
    p = write(f"{tmp_dir}/messy.csv", TITLE + [HEADER] + BODY)
    st = ci.analyze_structure(spark, p)
    assert st.header_row_index == 2
    assert st.header == HEADER.split(",")
    assert st.column_mappings == {"date": "Visit date", "capacity": "Seats",
                                  "attendees": "Head count", "building_name": "Site"}
    assert 0 < st.confidence <= 1
    assert st.to_frame(spark).count() == 1


def test_clean_messy_file(spark, tmp_dir):
    p = write(f"{tmp_dir}/messy.csv", TITLE + [HEADER] + BODY)
    c = cl.clean_table(spark, p)
    assert rows(c.table) == EXPECTED
    rep = c.report().first()
    assert (rep.rows_before, rep.rows_after, rep.removed) == (10, 5, 5)
    assert dict(c.table.dtypes)["Note"] == "string"


def test_three_files_agree_with_one(spark, tmp_dir):
    one = write(f"{tmp_dir}/one/messy.csv", TITLE + [HEADER] + BODY)
    parts = [BODY[:4], BODY[4:8], BODY[8:]]
    for i, part in enumerate(parts):
        write(f"{tmp_dir}/parts/p{i}.csv", [f"Export part {i}", ""] + [HEADER] + part)
    a = rows(cl.clean_table(spark, one).table)
    b = rows(cl.clean_table(spark, f"{tmp_dir}/parts").table)
    assert a == b == EXPECTED


def test_day_first_dates_choose_format(spark, tmp_dir):
    p = write(f"{tmp_dir}/dmy.csv", ["Site,Date,Attendees,Capacity",
                                      "A,13/01/2024,5,10", "A,02/01/2024,6,10"])
    got = rows(cl.clean_table(spark, p).table)
    assert got == {("A", dt.datetime(2024, 1, 13), 5.0, 10.0),
                   ("A", dt.datetime(2024, 1, 2), 6.0, 10.0)}


def test_cell_equal_to_header_is_dropped(spark, tmp_dir):
    p = write(f"{tmp_dir}/hv.csv", ["Site,Date,Attendees,Capacity,Note",
                                     "A,2024-01-01,5,10,x", "B,2024-01-02,6,10, note "])
    got = rows(cl.clean_table(spark, p).table)
    assert got == {("A", dt.datetime(2024, 1, 1), 5.0, 10.0)}


def test_missing_role_is_an_error(spark, tmp_dir):
    p = write(f"{tmp_dir}/nocap.csv", ["Site,Date,Attendees", "A,2024-01-01,5"])
    with pytest.raises(ValueError, match="Capacity"):
        cl.load_table(spark, p)


def test_empty_after_cleaning_is_an_error(spark, tmp_dir):
    p = write(f"{tmp_dir}/empty.csv", ["Site,Date,Attendees,Capacity", "A,not a date,x,y"])
    with pytest.raises(ValueError):
        cl.load_table(spark, p)


def test_preview_pads_short_rows(spark, tmp_dir):
    p = write(f"{tmp_dir}/m.csv", TITLE + [HEADER] + BODY)
    prev = ci.preview_raw(spark, p)
    assert len(prev) == 10 and all(len(r) == 5 for r in prev)
    assert prev[0] == ["Visitor report 2024", None, None, None, None]


def test_sinks_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("Main Hall", 3.0), ("Annex", 4.0)], "b STRING, v DOUBLE")
    sinks.write_summary(df, f"{tmp_dir}/sum", "csv")
    back = spark.read.schema(df.schema).option("header", True).csv(f"{tmp_dir}/sum")
    assert sorted(back.collect()) == sorted(df.collect())
    sinks.write_by_group(df, f"{tmp_dir}/by", "b")
    dirs = sorted(d for d in os.listdir(f"{tmp_dir}/by") if d.startswith("group_slug="))
    assert dirs == ["group_slug=Annex", "group_slug=Main_Hall"]


def test_row_id_follows_file_order(spark, tmp_dir):
    p = write(f"{tmp_dir}/rid.csv", TITLE + [HEADER] + BODY)
    t = cl.clean_table(spark, p, row_id=True).table
    got = [r["Building Name"] for r in t.orderBy("_row_id").collect()]
    assert got == ["North Hall", "South Hall", "East Wing", "East Wing", "East Wing"]
    assert dict(t.dtypes)["_row_id"] == "bigint"


@pytest.mark.parametrize("header", ["Building,Date,Total Attendees,Capacity", "Building,Date,Total visitors,Seats",
                                    "Building,Date,Maximum people seen,Capacity", "Gebaeude,Datum,Besucher,Plaetze",
                                    "Site,Visit date,Head count,Seats", "Site,Date,Count,Total"])
def test_roles_from_common_headers(spark, tmp_dir, header):
    p = write(f"{tmp_dir}/h.csv", [header] + [f"Hall {i % 3},2024-01-{i + 1:02d},{10 + i},{50 + i % 3}" for i in range(20)])
    names = header.split(",")
    got = ci.analyze_structure(spark, p).column_mappings
    assert got == {"building_name": names[0], "date": names[1], "attendees": names[2], "capacity": names[3]}


def test_undecidable_counts_are_an_error(spark, tmp_dir):
    p = write(f"{tmp_dir}/u.csv", ["Site,Date,A,B"] + [f"Hall,2024-01-{i + 1:02d},{i},{i}" for i in range(9)])
    with pytest.raises(ValueError, match="attendees from capacity"):
        ci.analyze_structure(spark, p)


def test_date_format_comes_from_all_rows(spark, tmp_dir):
    head = ["Building,Date,Attendees,Capacity"]
    late = head + ["A,N/A,5,10"] * 12 + [f"A,{i + 1}/1/2024,{i},10" for i in range(28)]
    mixed = head + ["A,2024-01-01,5,10"] * 12 + [f"A,{i % 28 + 1}/1/2024,{i},10" for i in range(280)]
    assert cl.clean_table(spark, write(f"{tmp_dir}/late.csv", late)).table.count() == 28
    assert cl.clean_table(spark, write(f"{tmp_dir}/mixed.csv", mixed)).table.count() == 280


def test_overlong_rows_are_an_error(spark, tmp_dir):
    p = write(f"{tmp_dir}/o.csv", ["Building,Date,Attendees,Capacity", "A,2024-01-01,5,10", "A,2024-01-02,5,10,7"])
    with pytest.raises(ValueError, match="expected 4 fields"):
        cl.load_table(spark, p)


def test_preamble_goes_by_place_not_by_value(spark, tmp_dir):
    p = write(f"{tmp_dir}/p.csv", ["Report,,,,", "Building,Date,Attendees,Capacity,Note", "A,2024-01-01,5,10,",
                                   "Report,,,,", "A,2024-01-02,6,10,"])
    prev = ci.preview_raw(spark, p)
    body = ci.scan_csv_header_offset(spark, p, prev, 1)
    assert sorted(r.Building for r in body.collect()) == ["A", "A", "Report"]


def test_quoted_cells(spark, tmp_dir):
    p = write(f"{tmp_dir}/q.csv", ['Building,Date,Attendees,Capacity,"The ""note"""',
                                   '"Hall, north",2024-01-01,5,10,"say ""hi"" now"'])
    t = cl.load_table(spark, p)
    assert t.columns[-1] == 'The "note"' and t.first()[0] == "Hall, north" and t.first()[4] == 'say "hi" now'
    m = write(f"{tmp_dir}/m.csv", ["Building,Date,Attendees,Capacity,Note", '"Hall', 'north",2024-01-01,5,10,"a', 'b"'])
    r = cl.load_table(spark, m, multiline=True).first()
    assert (r[0], r[4]) == ("Hall\nnorth", "a\nb")


def test_files_with_other_column_orders(spark, tmp_dir):
    """Each file's header is found on its own; columns go by their names."""
    write(f"{tmp_dir}/a.csv", ["Title", "Site,Date,Attendees,Capacity", "A,2024-01-01,5,10"])
    write(f"{tmp_dir}/b.csv", ["", "Other title", "x,y", "Capacity,Attendees,Date,Site", "20,6,2024-01-02,B"])
    write(f"{tmp_dir}/c.csv", ["C,2024-01-03,7,30"])  # no header: by position
    assert rows(cl.clean_table(spark, tmp_dir).table) == {
        ("A", dt.datetime(2024, 1, 1), 5.0, 10.0), ("B", dt.datetime(2024, 1, 2), 6.0, 20.0), ("C", dt.datetime(2024, 1, 3), 7.0, 30.0)}


def test_header_of_other_words_is_an_error(spark, tmp_dir):
    write(f"{tmp_dir}/a.csv", ["Site,Date,Attendees,Capacity", "A,2024-01-01,5,10"])
    write(f"{tmp_dir}/b.csv", ["Hall,When,Visitors,Seats", "B,2024-01-02,6,20"])
    with pytest.raises(ValueError, match="b.csv"):
        cl.clean_table(spark, tmp_dir)


def test_records_keep_their_place_when_splits_change(spark, tmp_dir):
    body = [f"Hall {i % 7},2024-01-{i % 28 + 1:02d},{i},{50 + i % 3}" for i in range(4000)]
    write(f"{tmp_dir}/a.csv", ["Report", "Site,Date,Attendees,Capacity", *body])
    write(f"{tmp_dir}/b.csv", ["Capacity,Attendees,Date,Site", *[",".join(reversed(r.split(","))) for r in body]])
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "8k")
        st = ci.analyze_structure(spark, tmp_dir)
        spark.conf.set(key, "100m")
        table = cl.clean_table(spark, tmp_dir, st).table
        spark.conf.set(key, "1k")
        got = table.groupBy("Building Name", "Date", "Attendees", "Capacity").count().collect()
    finally:
        spark.conf.set(key, old)
    assert len(got) == 4000 and {r["count"] for r in got} == {2}


def test_bad_records_raise_or_go_to_quarantine(spark, tmp_dir):
    head = "Site,Date,Attendees,Capacity"
    write(f"{tmp_dir}/in/a.csv", ["A title", head, "A,2024-01-02,5,10", "A,2024-01-03,6,10,7,8",
                                  "A,2024-01-04,7,10"])
    write(f"{tmp_dir}/in/b.csv", ["Item,Price,Colour,Weight", "1,2,3,4", "5,6,7,8"])
    write(f"{tmp_dir}/in/c.csv", ["B,2024-01-05,8,10", "B,2024-01-06,9,10,x"])
    with pytest.raises(ValueError, match="b.csv"):
        cl.load_table(spark, f"{tmp_dir}/in")
    t = cl.load_table(spark, f"{tmp_dir}/in", quarantine_path=f"{tmp_dir}/bad")
    assert rows(t) == {("A", dt.datetime(2024, 1, 2), 5.0, 10.0), ("A", dt.datetime(2024, 1, 4), 7.0, 10.0),
                       ("B", dt.datetime(2024, 1, 5), 8.0, 10.0)}
    bad = spark.read.parquet(f"{tmp_dir}/bad").orderBy("file", "row_id").collect()
    assert [(os.path.basename(r.file), r.reason, r.cells[:2], r.cells[4]) for r in bad] == [
        ("a.csv", "more than 4 fields", ["A", "2024-01-03"], "7"),
        ("b.csv", "header with other columns", ["Item", "Price"], None),
        ("b.csv", "header with other columns", ["1", "2"], None),
        ("b.csv", "header with other columns", ["5", "6"], None),
        ("c.csv", "more than 4 fields", ["B", "2024-01-06"], "x")]
    assert all(r.split_start == 0 for r in bad) and len({r.row_id for r in bad}) == 5


def test_strict_mode_refuses_a_wide_record(spark, tmp_dir):
    write(f"{tmp_dir}/a.csv", ["Site,Date,Attendees,Capacity", "A,2024-01-02,5,10", "A,2024-01-03,6,10,7"])
    with pytest.raises(ValueError, match="expected 4 fields"):
        cl.load_table(spark, f"{tmp_dir}/a.csv")
    with pytest.raises(ValueError, match="on_bad"):
        cl.clean_table(spark, f"{tmp_dir}/a.csv", on_bad="ignore")
    good = write(f"{tmp_dir}/g.csv", ["Site,Date,Attendees,Capacity", "A,2024-01-02,5,10"])
    assert cl.load_table(spark, good, quarantine_path=f"{tmp_dir}/none").count() == 1
    assert spark.read.parquet(f"{tmp_dir}/none").count() == 0


def test_groups_are_written_by_size(spark, tmp_dir):
    """A hot group (of equal rows) is written by several tasks, groups of one
    row share tasks, and every row is written once."""
    import glob
    from collections import Counter
    data = [("hot one", 7, "x" * 50)] * 4000 + [(f"g {i}", i, "y") for i in range(300)] + [(None, 1, None)] * 3
    df = spark.createDataFrame(data, "grp STRING, v INT, t STRING").repartition(8)
    sinks.write_by_group(df, f"{tmp_dir}/out", "grp", file_bytes=40_000)
    back = spark.read.parquet(f"{tmp_dir}/out")
    assert Counter(tuple(r) for r in back.select("grp", "v", "t").collect()) == Counter(data)
    assert set(back.columns) == {"grp", "v", "t", "group_slug"}
    task = lambda p: os.path.basename(p).split("-")[1]
    hot = {task(p) for p in glob.glob(f"{tmp_dir}/out/group_slug=hot_one/*.parquet")}
    single = {task(p) for p in glob.glob(f"{tmp_dir}/out/group_slug=g_*/*.parquet")}
    assert len(hot) >= 4 and len(single) <= 16
    sinks.write_by_group(df.where("v = 7"), f"{tmp_dir}/csv", "grp", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/csv").count() == 4001
    sinks.write_by_group(df.limit(0), f"{tmp_dir}/none", "grp")


def test_cells_are_computed_once(spark, tmp_dir):
    """A later filter does not repeat the work of the steps before it."""
    with open(f"{tmp_dir}/v.csv", "w") as f:
        f.write("Site,Visit date,Head count,Seats\nA,2024-01-02,5,10\nB,2024-01-03, 6 ,N/A\nB,x,7,9\n")
    table = cl.clean_table(spark, tmp_dir).table
    plan = table._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("gettimestamp(") == 1
    assert plan.count("rlike(") == 3  # the date's shape and two numbers
    assert plan.count("inset") == 4  # one test for missing-value tokens a column
    assert [tuple(r)[0] for r in table.collect()] == ["A"]


def test_date_shape_leaves_out_no_date(spark):
    """The pattern before the parser changes no result."""
    from capsight.functions.exprs import DATE_FORMATS, parse_date
    texts = ["2024-01-02", " 2024-01-02 ", "2024-1-2", "2024-13-02", "2024-02-30", "02024-01-02", "2024-01-02 03:04:05", "2024-01-02t03:04:05",
             "2024-01-02T03:04:05", "2024-01-02 03:04", "1/2/2024", "13/2/2024", "2/13/2024", "01/02/2024", "001/2/2024", "1/2/2024 3:04",
             "1/2/2024 13:04", "2024/1/2", "2024/13/2", "1-2-2024", "31-1-2024", "1.2.2024", "Jan 2, 2024", "jan 2, 2024", "May 12, 2024",
             "2 Jan 2024", "January 2, 2024", "2 May 2024", "12 december 2024", "-5/2/2024", "+1/2/2024", "12024-01-02", "+12024-01-02",
             "", "\t1/2/2024", "1/2/2024\n", "0/1/2024", "N/A", None, "1/2/24", "24-01-02", "2024-01-02 3:04", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    plain = lambda f: F.try_to_timestamp(F.btrim("s"), F.lit(f)).cast("timestamp_ntz")
    row = df.select("s", *[parse_date("s", f).cast("string").alias(f"a{k}") for k, f in enumerate(DATE_FORMATS)],
                    *[plain(f).cast("string").alias(f"b{k}") for k, f in enumerate(DATE_FORMATS)]).collect()
    for r in row:
        for k, f in enumerate(DATE_FORMATS):
            assert r[f"a{k}"] == r[f"b{k}"], (r["s"], f)
    assert all(any(r[f"a{k}"] is not None for r in row) for k in range(len(DATE_FORMATS)))


def test_first_visits_beyond_the_smallest_line_items(spark, tmp_dir, monkeypatch):
    """Line items without a part do not take the place of first visits."""
    monkeypatch.setattr(messy, "LOWEST", 2)
    day = dt.datetime(2024, 1, 2)
    items = [(k, 1, p, 1, 5.0, day, 0.0) for k, p in [(None, 9), (1, 9), (2, 9), (3, 1), (4, 2), (5, 1), (6, None)]]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double,"
                          "l_shipdate timestamp_ntz, l_discount double").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.createDataFrame([(1, "A", 7), (2, "B", 8)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    visits = messy.visits_clean(spark, tmp_dir)
    assert [messy._first_key(spark, tmp_dir, visits, n)[0] for n in (1, 2, 9)] == [3, 4, 5]
    monkeypatch.setattr(messy, "LOWEST", 5)
    assert [messy._first_key(spark, tmp_dir, visits, n)[0] for n in (1, 2, 3)] == [3, 4, 5]


def test_profile_of_odd_texts(spark):
    """One kind a cell and plain ISO days counted at once: the same profile as
    every test of every cell by itself."""
    from capsight.functions.exprs import DATE_FORMATS, parse_date
    number = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
    odd = ["1", " 12 ", "+3", "-4.", ".5", "1e5", "1e", "1.5E-3", "1d", "2f", "inf", "-Infinity", "INF ", "infinit", "nan", "1,234", "", " ",
           "5\n", "6\t", "1.2", "1.2.", "--1", "+", ".", "e5", "12 May", "x", "٣", "7 ", "Jan 2, 2024", "0x10", "1_0", None]
    days = ["2024-01-02", "2024-02-30", "2024-13-02", "2024-01-32", "0000-01-01", "9999-12-31"]
    near = ["2024-1-2 x", "2024-01-2 ", "2024-01-2T", " 2024-01-2", "2024-01-02 ", " 2024-01-02", "2024-01-02\n", "2024-1--02", "+024-01-02", "2024-01-0x",
            "2024-01-٢٣", "2024-01-02 03:04", "2024-01-02T03:04:05"]
    columns = {"odd": odd, "days": days, "near": near + days, "signed": [*days, "+12024-01-02", "-2024-01-02", " +12024-01-02"],
               "both": [*days, "2/1/2024", "13/1/2024"], "slash": ["1/2/2024", "13/2/2024", "x"], "none": [None]}
    size = max(map(len, columns.values()))
    rows = list(zip(*[v + [None] * (size - len(v)) for v in columns.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    got = ci.profile_strings(df)
    for c in columns:
        plain = lambda f: F.try_to_timestamp(F.btrim(c), F.lit(f)).cast("timestamp_ntz")  # noqa: B023, E731
        r = df.agg(F.count(c), F.count(F.when(F.col(c).rlike(number), F.col(c).try_cast("double"))),
                   F.count_if(F.col(c).rlike(r"^\s*[-+]?\d+\s*$")), *[F.count(plain(f)) for f in DATE_FORMATS],
                   *[F.count_if(~plain(f).eqNullSafe(parse_date(c, f))) for f in DATE_FORMATS]).first()
        best = max(range(len(DATE_FORMATS)), key=lambda k: (r[3 + k], -k))
        n = r[0] or 1
        p = got[c]
        assert (p["n"], p["numeric"], p["integer"], p["date"]) == (r[0], r[1] / n, r[2] / n, r[3 + best] / n), c
        assert p["date_format"] == DATE_FORMATS[best], c
        assert not any(r[3 + len(DATE_FORMATS):]), c
    assert got["days"]["date"] == 0.5


def test_plain_days_take_no_second_pass(spark):
    """The profile of ISO days is one aggregate; other dates take two."""
    def jobs(texts):
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        group = f"profile-{texts[0]}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert ci.profile_strings(df)["s"]["date"] == 1.0
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs(["2024-01-02", "2024-01-03"]) < jobs(["1/2/2024", "1/3/2024"])


def test_short_records_are_filled_by_the_parser(spark, tmp_dir, monkeypatch):
    """A declared column stays unread, so that a record of the header's width is
    no exception in the reader; records of every width read as before."""
    with open(f"{tmp_dir}/v.csv", "w") as f:
        f.write('a,b\n1,2\n3\n"4 ""x""",,6\n7,8,9,10,11\n\n,\n"a,b"\n')
    monkeypatch.setattr(ci, "stage", lambda df, cols, name: df.select(*cols))
    records = ci.read_records(spark, tmp_dir, 2)
    assert records.columns == ["_c0", "_c1", "_c2", "_file", "_start", "_row_id"]
    scan = records._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_c0:string,_c1:string,_c2:string>" in scan
    assert "_unread" in records._jdf.queryExecution().analyzed().toString()
    for multiline in (False, True):
        got = [tuple(r)[:3] for r in ci.read_records(spark, tmp_dir, 2, multiline).orderBy("_row_id").collect()]
        assert got == [("a", "b", None), ("1", "2", None), ("3", None, None), ('4 "x"', None, "6"), ("7", "8", "9"),
                       (None, None, None), ("a,b", None, None)], multiline


def test_profile_tests_each_text_once(spark, monkeypatch):
    """Equal cells are counted before they are tested, and each counts as often as rows hold it."""
    rows = ([("7", "31/12/2024", None)] * 500 + [(" 2.5 ", "1/2/2024", "x")] * 300 + [("inf", "30/2/2024", "x")] * 150
            + [("n", None, "y")] * 50)
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING")
    counts = {(r["_i"], r["_s"]): r["_n"] for r in ci.cell_counts(df, df.columns).collect()}
    assert counts == {(0, "7"): 500, (0, " 2.5 "): 300, (0, "inf"): 150, (0, "n"): 50, (1, "31/12/2024"): 500,
                      (1, "1/2/2024"): 300, (1, "30/2/2024"): 150, (2, "x"): 450, (2, "y"): 50}
    asked, whole = [], ci.cell_counts
    monkeypatch.setattr(ci, "cell_counts", lambda d, cols: asked.append(list(cols)) or whole(d, cols))
    p = ci.profile_strings(df)
    assert asked == [["a", "b", "c"], ["b"]]
    assert (p["a"]["n"], p["a"]["numeric"], p["a"]["integer"], p["a"]["mean"]) == (1000, 0.95, 0.5, (7 * 500 + 2.5 * 300) / 800)
    assert (p["b"]["n"], p["b"]["date"], p["b"]["date_format"], p["b"]["distinct"]) == (950, 800 / 950, "d/M/yyyy", 3)
    assert (p["c"]["n"], p["c"]["numeric"], p["c"]["mean"], p["c"]["distinct"]) == (500, 0.0, None, 2)


def test_distinct_texts_are_counted_exactly(spark):
    df = spark.range(30000).selectExpr("CAST(id % 20000 AS STRING) AS a", "CAST(id % 9000 AS STRING) || 'x' AS b")
    p = ci.profile_strings(df)
    assert (p["a"]["distinct"], p["b"]["distinct"]) == (20000, 9000)


def test_repeated_headers_in_any_dress(spark):
    """The cheap test lets every cell through that equals its column's name."""
    cells = ["note", " NOTE", "\t\vNote \n", "İd", " i̇D", "", "x note", "notes", "n", None, "id"]
    df = spark.createDataFrame([(c, c) for c in cells], "note STRING, `İd` STRING")
    assert {r[0] for r in cl.drop_repeated_headers(df).collect()} == {"", "x note", "notes", "n", None, "id"}
    start = df.select("note", cl.may_equal(F.col("note"), "note").alias("m")).where("m").collect()
    assert {r[0] for r in start} == {"note", " NOTE", "\t\vNote \n", "x note", "notes"}
