"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document becomes hashed counts of its words and of its character shapes
(classes of letters, digits, spaces and the punctuation itself), damped,
weighted by inverse document frequency and projected on the leading singular
vectors of the labelled documents. The labelled vectors (at most ``SAMPLE``,
a few MB whatever the size of the corpus) go to every task; each document's
cosine with all of them is computed exactly, in blocks, and its ``K`` nearest
vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm import text as tx
from capsight.llm.common import ship
from capsight.llm.labelled import held_out, training_rows

SAMPLE, K, RANK, POWER = 4096, 15, 48, 8
_WORDS, _SHAPES, _MARKS = 2048, 2048, 4
DIM = _WORDS + _SHAPES + _MARKS
_BLOCK = 128

_CLASS = np.zeros(256, np.uint32)  # letters and bytes of other letters: 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
for _i, _b in enumerate(b for b in range(128) if _CLASS[b] == 0 and not 97 <= b <= 122):
    _CLASS[_b] = 5 + _i % 59


def features(buf, off) -> np.ndarray:
    """Damped counts, float32 [documents, DIM]."""
    n = len(off) - 1
    low = tx.lower(buf)
    start, end, doc = tx.words(low, off)
    h = tx.span_hash(low, start, end)
    cells = [doc * DIM + (h % np.uint64(_WORDS)).astype(np.int64)]
    c = _CLASS[buf]
    if len(c) >= 4:
        owner = np.repeat(np.arange(n), np.diff(off))
        gram = (c[:-3] << 18) | (c[1:-2] << 12) | (c[2:-1] << 6) | c[3:]
        here = np.flatnonzero(owner[:-3] == owner[3:])
        g = gram[here] * np.uint32(2654435761)
        cells.append(owner[here] * DIM + _WORDS + (g >> np.uint32(21)).astype(np.int64))
    out = np.bincount(np.concatenate(cells), minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    # marks: words equal to the word before, words seen before, all words
    base = _WORDS + _SHAPES
    if len(h) > 1:
        same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        out[:, base] = np.bincount(doc[same], minlength=n)
    total = np.bincount(doc, minlength=n)
    b = tx.bounds(doc, n)
    out[:, base + 1] = [total[i] - len(np.unique(h[b[i]:b[i + 1]])) for i in range(n)]
    # rates, not lengths: a document's counts as if it had 256 words
    out *= (256.0 / np.maximum(total, 1))[:, None].astype(np.float32)
    return np.log1p(out, out=out)


class Model:
    """Labelled vectors and the projection; ``score`` votes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        df = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.1
        # repetition marks are few against thousands of buckets
        self.idf[_WORDS + _SHAPES:] *= 4
        x = x * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rank = min(RANK, *x.shape) if len(x) else 0
        q = np.random.default_rng(3).standard_normal((DIM, rank)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        self.basis = np.ascontiguousarray((self.idf[:, None] * q).astype(np.float32))
        v = x @ q
        self.vectors = np.ascontiguousarray(
            (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).T.astype(np.float32))

    def score(self, feats: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(feats), 0.5)
        v = feats @ self.basis
        norm = np.linalg.norm(v, axis=1)
        sim = (v / np.maximum(norm, 1e-9)[:, None]) @ self.vectors
        k = min(K, len(self.y))
        top = np.argpartition(sim, len(self.y) - k, axis=1)[:, -k:]
        w = np.maximum(np.take_along_axis(sim, top, axis=1), 0).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        vote = (w * self.y[top]).sum(axis=1)
        some = (norm > 0) & (total > 1e-12)
        return np.where(some, vote / np.where(some, total, 1), self.prior)


def _blocks(column):
    for i, _, buf, off in tx.slices(column):
        for s in range(0, len(off) - 1, _BLOCK):
            o = off[s:s + _BLOCK + 1]
            yield i + s, features(buf[o[0]:o[-1]], o - o[0])


def _sample_job(batches):
    for b in batches:
        for i, x in _blocks(b.column("text")):
            n = len(x)
            rows = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([
                b.column("label").slice(i, n),
                pa.array([r.tobytes() for r in rows], pa.binary()),
                pa.array([x[j, r].tobytes() for j, r in enumerate(rows)], pa.binary())],
                names=["label", "at", "value"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """Learns from at most ``bound`` labelled rows outside the held-out fold.
    Their sparse counts, a few KB each, come to the driver."""
    ship(docs.sparkSession)
    rows = (training_rows(docs, labels, label, bound).select("label", "text")
            .mapInArrow(_sample_job, "label int, at binary, value binary").toArrow())
    x = np.zeros((rows.num_rows, DIM), np.float32)
    for j, (at, value) in enumerate(zip(rows["at"].to_pylist(), rows["value"].to_pylist(), strict=True)):
        x[j, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    y = np.array(rows["label"].to_pylist(), np.float32)
    order = np.lexsort((x.sum(axis=1), y))  # the order of arrival decides nothing
    return Model(x[order], y[order])


def _score_job(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            for i, x in _blocks(b.column("text")):
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, n) for c in b.columns[1:]] + [pa.array(model.score(x), pa.float64())],
                    names=[*b.schema.names[1:], "score"])
    return run


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` (any columns, with ``text``) and as ``column``, a name that none
    of them has, their score in 0..1, the weighted share of good neighbours."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    if column in docs.columns:
        raise ValueError(f"column {column!r} exists")
    other = docs.schema.fields
    # the text to score goes first; the columns follow under plain names
    rows = docs.select(F.col("text").cast("string"), *[F.col(f"`{f.name}`") for f in other])
    rows = rows.toDF("text", *[f"c{i}" for i in range(len(other))])
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(other)) + ", score double"
    return rows.mapInArrow(_score_job(shared), plain).toDF(*[f.name for f in other], column)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score and
    predicted (score >= 0.5).

    A null, empty or wordless text has no direction and gets the share of
    good documents among the labelled; without labelled rows every score is
    0.5. Repeated rows score alike; a null doc_id is not held out. lang,
    source, doc_id and labels never enter a score.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
