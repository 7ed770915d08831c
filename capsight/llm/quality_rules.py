"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds one ratio of a document (lengths, symbols, stop words,
lines). Counts and ratios are built-in functions over the document's own
word and line arrays, so the whole evaluation is a narrow projection: no
user function, no shuffle, one document at a time, whole texts.

Repeated three-word windows are found by sorting the document's windows
(64-bit hash and position) and comparing neighbours; a document whose windows
all differ skips the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Space and 0x09-0x0D.
_WS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple("""
the of and to a in is it that for was on are as with be by this
der die das und ist nicht ein eine von mit den zu im auf
le la les de des et est un une que dans pour qui pas
el los las y en es por con una del se no
""".split())

# name, value (an expression over the counts), lowest and highest allowed
RULES = (
    ("mean word length", "word_chars / n_words", 2.0, 14.0),
    ("symbols per word", "n_symbols / n_words", None, 0.25),
    ("stop words per word", "n_stop_words / n_words", 0.04, None),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("words per line", "n_words / n_lines", 1.5, None),
)



def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Appends n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_stop_words and n_repeat_words (long) to ``docs``, whose own columns must
    not bear these names."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ws = F.lit(_WS)
    d = docs.withColumn("_t", t)
    trimmed = F.btrim("_t", ws)
    d = d.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>"))
                     .otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, ws) != "")
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", _WS, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "_l": lines,
        "_g": F.when(F.size("_w") >= 3, F.expr(
            "transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")),
        "n_stop_words": F.size(F.filter("_w", lambda x: F.btrim(x, F.lit(".,;:?")).isin(*STOP_WORDS))).cast("long"),
    })
    d = d.withColumns({
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.when(F.size("_g") != F.size(F.array_distinct("_g")), F.sort_array(F.expr(
            "transform(_g, (h, i) -> struct(h as h, i as p))"))),
    })
    twice = F.expr("filter(_s, (x, i) -> (i > 0 and _s[greatest(i - 1, 0)].h = x.h) or "
                   "(i + 1 < size(_s) and _s[least(i + 1, size(_s) - 1)].h = x.h))")
    d = d.withColumn("_p", twice)
    covered = F.expr("size(array_distinct(flatten(transform(_p, x -> array(x.p, x.p + 1, x.p + 2)))))")
    d = d.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return d.drop("_t", "_w", "_l", "_g", "_s", "_p")


def verdict(rules=RULES):
    """The rule table as one boolean column; a ratio of nothing passes."""
    ok = F.lit(True)
    for _, value, low, high in rules:
        num, den = value.split(" / ")
        v = F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
        if low is not None:
            ok = ok & F.coalesce(v >= low, F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(v <= high, F.lit(True))
    return ok


def rule_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, the counts,
    base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words stand in
    three-word windows that the text holds twice or more. kept: not
    base_failed and every rule holds. A null text has no words and fails;
    repeated rows and null ids are judged row by row; other columns are
    ignored.
    """
    c = counts(docs.select("doc_id", "text")).drop("text")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    c = c.withColumn("base_failed", failed)
    return c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"), "n_lines", "n_stop_words")
