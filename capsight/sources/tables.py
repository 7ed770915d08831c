"""Parquet inputs (S6) and the analysis views built on the driver's tables.

The views map the TPC-H-like tables onto the attendance shape the
operators expect (group, timestamp, attendees, capacity). Each is a lazy
DataFrame: Catalyst prunes the scans to the columns used and pushes filters
into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.roles import Roles

# Row key that makes the date order total in `visits` (l_orderkey,
# l_linenumber alone is not unique in the generated lineitem).
VISIT_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
VISITS = Roles(group="building", date="visit_date", primary="attendees",
               secondary="capacity", order_key=VISIT_KEY)
USAGE = Roles(group="building", date="visit_date", primary="attendees",
              secondary="capacity", order_key=("event_id",))
ORDER_VALUES = Roles(group="segment", date="order_date", primary="total_price",
                     secondary="acct_balance", order_key=("order_key",))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored: a ``where`` on any column reaches the scan. NaN is
    told from a number by the operators (:mod:`capsight.functions.missing`)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part: building = brand, one visit per line item.

    No broadcast hint: the planner broadcasts `part` only while its
    measured size is under the broadcast threshold (AQE re-checks at run
    time) and falls back to a shuffled join beyond it.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        "l_discount")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return (li.join(part, li.l_partkey == part.p_partkey)
              .select(F.col("p_brand").alias("building"),
                      F.col("l_shipdate").alias("visit_date"),
                      F.col("l_quantity").alias("attendees"),
                      F.col("p_size").cast("double").alias("capacity"),
                      "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"))


def visits_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).drop("l_discount")


def visits_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` with capacity 0 wherever the discount is 0 (infinity cases)."""
    v = visits(spark, sf_dir)
    return v.withColumn("capacity", F.when(F.col("l_discount") == 0, F.lit(0.0))
                        .otherwise(F.col("capacity"))).drop("l_discount")


def visits_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` with NULL attendees on line 3 and NULL building on line 5."""
    v = visits(spark, sf_dir)
    return (v.withColumn("attendees", F.when(F.col("l_linenumber") == 3, F.lit(None))
                         .otherwise(F.col("attendees")))
             .withColumn("building", F.when(F.col("l_linenumber") == 5, F.lit(None))
                         .otherwise(F.col("building")))
             .drop("l_discount"))


def visits_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` as a table whose missing attendees were written as NaN (line
    3) and missing capacities too (line 5)."""
    v = visits(spark, sf_dir)
    nan = F.lit(float("nan"))
    return v.withColumns({
        "attendees": F.when(F.col("l_linenumber") == 3, nan).otherwise(F.col("attendees")),
        "capacity": F.when(F.col("l_linenumber") == 5, nan).otherwise(F.col("capacity"))}).drop("l_discount")


def visits_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` with the visits of line 7 a hundred and twenty years earlier."""
    v = visits_clean(spark, sf_dir)
    early = F.col("visit_date") - F.expr("INTERVAL '120' YEAR")
    return v.withColumn("visit_date", F.when(F.col("l_linenumber") == 7, early).otherwise(F.col("visit_date")))


def visits_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` with every row in one building: the hot-group case (one key
    holds all rows). The key is computed from the data, as a real hot key
    is, so the optimizer cannot fold it into a constant."""
    return visits_clean(spark, sf_dir).withColumn(
        "building", F.concat(F.lit("All"), F.substring("building", 1, 0)))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-day event stream: event type as building, props.k as capacity."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("event_type").alias("building"),
                     F.col("ts").alias("visit_date"), F.col("value").alias("attendees"),
                     F.get_json_object("props", "$.k").try_cast("double").alias("capacity"))


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic two-metric table: orders with their customer's segment."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                  "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.col("c_mktsegment").alias("segment"),
                     F.col("o_orderdate").alias("order_date"),
                     F.col("o_totalprice").alias("total_price"),
                     F.col("c_acctbal").alias("acct_balance"),
                     F.col("o_orderkey").alias("order_key")))


# DuckDB views equal to the DataFrames above, for the SQL oracle.
ORACLE_VIEWS = {
    "visits": """SELECT p_brand AS building, l_shipdate AS visit_date,
       l_quantity AS attendees, CAST(p_size AS DOUBLE) AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "visits_zero": """SELECT p_brand AS building, l_shipdate AS visit_date,
       l_quantity AS attendees,
       CASE WHEN l_discount = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "visits_null": """SELECT CASE WHEN l_linenumber = 5 THEN NULL ELSE p_brand END AS building,
       l_shipdate AS visit_date,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS attendees,
       CAST(p_size AS DOUBLE) AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "visits_one": """SELECT 'All' || substr(p_brand, 1, 0) AS building, l_shipdate AS visit_date,
       l_quantity AS attendees, CAST(p_size AS DOUBLE) AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "visits_nan": """SELECT p_brand AS building, l_shipdate AS visit_date,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS attendees,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "visits_gap": """SELECT p_brand AS building,
       CASE WHEN l_linenumber = 7 THEN l_shipdate - INTERVAL 120 YEAR ELSE l_shipdate END AS visit_date,
       l_quantity AS attendees, CAST(p_size AS DOUBLE) AS capacity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "usage": """SELECT event_id, event_type AS building, ts AS visit_date, value AS attendees,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS capacity
FROM events""",
    "order_values": """SELECT c_mktsegment AS segment, o_orderdate AS order_date,
       o_totalprice AS total_price, c_acctbal AS acct_balance, o_orderkey AS order_key
FROM orders JOIN customer ON o_custkey = c_custkey""",
}

VIEW_FRAMES = {
    "visits": visits_clean,
    "visits_zero": visits_zero,
    "visits_null": visits_null,
    "visits_one": visits_one,
    "visits_nan": visits_nan,
    "visits_gap": visits_gap,
    "usage": usage,
    "order_values": order_values,
}

VIEW_ROLES = {
    "visits": VISITS, "visits_zero": VISITS, "visits_null": VISITS, "visits_one": VISITS,
    "visits_nan": VISITS, "visits_gap": VISITS,
    "usage": USAGE, "order_values": ORDER_VALUES,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the views it uses."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{ORACLE_VIEWS[n]}\n)" for n in names)
    body = sql.lstrip()
    if body.upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"   # the query starts with its own CTEs
