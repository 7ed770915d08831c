"""Mixing sources to target weights.

Each source has a weight; the mix as a whole has a size given as a share of
all words. Words are counted per source, every source gets a target by its
weight, a target never exceeds ``cap`` times the source's own size, and what
a capped source cannot take goes to the others by weight until no target is
above its cap. A source's repetition rate is target / size, and each of its
documents is emitted floor(rate) times plus once more with probability equal
to the fraction, decided by a seeded hash of its doc_id and text (so that
texts under a null or repeated id draw on their own). Reruns therefore agree,
and no state is kept between documents.

Only DataFrame functions are used. The only grouping of documents is the
partial sum per source, so a source that holds a third of all rows costs one
row per task; the per-source table is joined back with a broadcast only after
its size was measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsight.functions.joins import join_small
from capsight.llm.common import stage

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(df: DataFrame, source: str) -> DataFrame:
    """(s_null, s_key): sorts by code point with null last and joins null to
    null."""
    return df.withColumns({"s_null": F.col(source).isNull(), "s_key": F.coalesce(F.col(source).cast("string"), F.lit(""))})


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(s_null, s_key, source_size, target) from ``sizes(source, size)``.

    Positions of sources are found by range partitions (a rank within each
    plus the sizes of those before), so no task sorts all sources. The level
    at which targets stop rising is found by aggregates of one row each: caps
    only ever join the capped set, so the rounds end.
    """
    per = (_key(sizes, "source").groupBy("s_null", "s_key").agg(F.sum("size").alias("source_size"))
           .repartitionByRange("s_null", "s_key").withColumn("pid", F.spark_partition_id()))
    per = stage(per, "sources")
    before = (per.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("pid")) - F.col("n")).select("pid", "before"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("s_null", "s_key")) - 1 + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = stage(per.join(before, "pid").withColumn("rank", rank).select("s_null", "s_key", "source_size", w.alias("w")), "weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    size = share * total
    top = F.col("source_size") * cap
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("w") * F.lit(level) > top
        r = per.agg(F.sum(F.when(over, top)).alias("taken"), F.sum(F.when(~over, F.col("w"))).alias("free"),
                    F.count(F.when(over, True)).alias("n")).first()
        if r["n"] == capped or not r["free"]:
            break
        level, capped = (size - (r["taken"] or 0)) / r["free"], r["n"]
    return per.select("s_null", "s_key", "source_size",
                      F.least(F.col("w") * F.lit(level or 0.0), top.cast("double")).alias("target"))


def draw(doc_id, text, seed: str = SEED):
    """A number in 0..1: 52 bits of md5(seed:doc_id:text), null as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), parts[0], F.lit(":"), parts[1])), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(draw, source_size, target):
    """floor(rate) plus one with probability rate - floor(rate); 0 for a source
    without words."""
    rate = F.coalesce(F.try_divide(target, source_size), F.lit(0.0))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, size (words),
    source_size, target, taken (size * copies), copies.

    A null text has size 0, a null source is a source of its own (last), rows
    that repeat a doc_id and its text draw alike, other columns are ignored; an
    empty table gives no rows.
    """
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.col("source").cast("string").alias("source"),
                              n_words(F.col("text")).alias("size"),
                              draw(F.col("doc_id").cast("long"), F.col("text"), seed).alias("draw")), "sizes")
    goal = source_targets(sized, weights, share, cap)
    return (join_small(_key(sized, "source"), goal, ["s_null", "s_key"])
            .withColumn("copies", copies(F.col("draw"), F.col("source_size"), F.col("target")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns, as often as
    :func:`mix_plan` counts."""
    names = docs.columns
    sized = docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    goal = source_targets(sized, weights, share, cap)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = _key(inner.withColumn("source", F.col("row.source")), "source")
    n = copies(draw(F.col("row.doc_id").cast("long"), F.col("row.text"), seed), F.col("source_size"), F.col("target"))
    return (join_small(keyed, goal, ["s_null", "s_key"]).withColumn("n", n).filter("n > 0")
            .withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("row.*"))
