"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes decides where a text is cut, so a
cut depends on nothing else and an insertion shifts no cut beyond it. Chunks
are compared by a 128-bit digest. Of equal chunks the first (smallest doc_id,
then place) stays; a run of later chunks is cut out when it is ``MIN_RUN``
bytes or longer, so chance agreements of a few words are left alone.

Counting goes in two steps: a partial count of 64-bit digests finds the few
that occur again, and only chunks with such a digest travel further. Both
counts are partial aggregates, so a passage that a third of all documents
share costs one row per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm import text as tx
from capsight.llm.common import drop_staged, ship, stage

WINDOW, RATE_BITS, MIN_GAP, MIN_RUN = 16, 4, 12, 96
BROADCAST_ROWS = 1_000_000  # spans: 24 bytes each and 24 a document

_GEAR = np.random.default_rng(99).integers(0, 1 << 16, 256).astype(np.uint16)


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Chunk starts of the slice, document starts among them, ascending. A
    place is cut when the hash of the WINDOW bytes before it has RATE_BITS
    leading zeros, a character starts there, and no other such place lies in
    the MIN_GAP bytes before."""
    h = _GEAR[buf]
    k = 1
    while k < WINDOW:
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint16(k)
        h = nxt
        k *= 2
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:-1] < (1 << (16 - RATE_BITS))) + 1
    at = at[(buf[at] & 0xC0) != 0x80]
    doc = np.searchsorted(off, at, "right") - 1
    at = at[at - off[doc] >= WINDOW]
    if len(at):
        doc = np.searchsorted(off, at, "right") - 1
        near = np.zeros(len(at), bool)
        near[1:] = (np.diff(at) < MIN_GAP) & (doc[1:] == doc[:-1])
        at = at[~near]
    starts = off[:-1][np.diff(off) > 0]
    return np.union1d(at, starts)


# a second alphabet makes the second half of the digest independent
_OTHER = np.random.default_rng(5).permutation(256).astype(np.uint8)


def _digest_job(batches):
    for b in batches:
        for _, _, buf, off in tx.slices(b.column("text")):
            s = cuts(buf, off)
            e = np.append(s[1:], len(buf))
            yield pa.RecordBatch.from_arrays([pa.array(tx.span_hash(buf, s, e).view(np.int64))], names=["h1"])


def _chunk_job(batches):
    for b in batches:
        keys = b.column("row_key").to_numpy(zero_copy_only=False)
        for i, j, buf, off in tx.slices(b.column("text")):
            s = cuts(buf, off)
            e = np.append(s[1:], len(buf))
            doc = np.searchsorted(off, s, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(tx.span_hash(buf, s, e).view(np.int64)),
                pa.array(tx.span_hash(_OTHER[buf], s, e).view(np.int64)),
                b.column("doc_id").slice(i, j - i).take(pa.array(doc)), pa.array(keys[i:j][doc]),
                pa.array((s - off[doc]).astype(np.int32)), pa.array((e - s).astype(np.int32))],
                names=["h1", "h2", "doc_id", "row_key", "start", "length"])


def _cut_job(names):
    def run(batches):
        for b in batches:
            out, total, gone, spans, sha = [], [], [], [], []
            for t, s in zip(b.column("text"), b.column("spans"), strict=True):
                raw = (t.as_py() or "").encode()
                cut = sorted((x["start"], x["end"]) for x in s.as_py()) if s.is_valid else []
                keep, at = [], 0
                for a, e in cut:
                    keep.append(raw[at:a])
                    at = e
                keep.append(raw[at:])
                left = b"".join(keep)
                out.append(left.decode())
                total.append(len(raw))
                gone.append(len(raw) - len(left))
                spans.append(len(cut))
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(out, pa.string()),
                 *[b.column(c) for c in names]], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *names])
    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans[start, end]) in bytes of what goes from the
    rows of ``docs(doc_id, row_key, text)``."""
    again = stage(docs.select("text").mapInArrow(_digest_job, "h1 long").groupBy("h1")
                  .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"), "digests")
    chunks = docs.select("doc_id", "row_key", "text").mapInArrow(
        _chunk_job, "h1 long, h2 long, doc_id long, row_key long, start int, length int")
    # the repeated digests grow with the corpus, so both sides are shuffled at
    # every size
    chunks = stage(chunks.join(again, "h1", "left_semi"), "chunks")
    place = F.struct("doc_id", "row_key", "start")
    first = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = chunks.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    w = Window.partitionBy("doc_id", "row_key").orderBy("start")
    later = later.select("doc_id", "row_key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    runs = (later.withColumn("new", (~F.col("start").eqNullSafe(F.lag("end").over(w))).cast("long"))
            .withColumn("run", F.sum("new").over(w))
            .groupBy("doc_id", "row_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .filter(F.col("end") - F.col("start") >= MIN_RUN)
            .groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    runs = stage(runs, "spans")
    drop_staged(docs.sparkSession, again, chunks)
    return runs


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` as columns c0, c1, ... with n_bytes, n_removed, n_spans,
    kept_sha256 and kept (the text left)."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = plain.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "text": F.col(at["text"]).cast("string")})
    keyed = keyed.withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed)
    small = spans.agg(F.count(F.lit(1)) + F.sum(F.size("spans"))).first()[0] or 0
    spans = spans.select(F.col("doc_id").alias("d_"), F.col("row_key").alias("k_"), "spans")
    side = F.broadcast(spans) if small <= BROADCAST_ROWS else spans
    joined = keyed.join(side, (F.col("row_key") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("d_")), "left")
    names = plain.columns
    schema = ("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, "
              + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields))
    return joined.select("text", "spans", *names).mapInArrow(_cut_job(names), schema)


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256 (of the bytes left) and text (what is left).

    A null or empty text has nothing to remove; rows that repeat a doc_id and
    its text are one document and are cut alike; the same text under another
    doc_id is a later copy; a null doc_id comes before all others.
    """
    out = _cut(docs.select("doc_id", "text"))
    return out.select(F.col("c0").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                      F.col("kept").alias("text"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, its texts cut as in
    :func:`dedup_report`. A null text becomes empty."""
    names = docs.columns
    out = _cut(docs)
    return out.select(*[(F.col("kept") if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
