"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into an embedding table, a word's embedding being the sum of
those of the word and of its first few bytes (so that forms of one stem share
what is learnt); filters of several widths run over
the word sequence of the whole text, each is pooled by its maximum, and a
logistic layer reads the pooled values. The model is trained with Adam on at
most ``SAMPLE`` labelled rows; it starts from the words' log-odds in those
rows, which max pooling alone would take many passes to find. Scoring runs in
Spark tasks over all documents: the filters' responses to each embedding are
tables, so a text costs a few gathers per word.

Thresholds are calibrated by language on the training rows (a language is
never an input of a score).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm import text as tx
from capsight.llm.common import ship
from capsight.llm.labelled import held_out, training_rows

SAMPLE = 5120
PREFIXES = (4, 5, 6)
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 8, 64, 0.003
MIN_DOCS = 3  # a word in fewer training rows starts neutral
TOXIC_AT, MIN_LEVEL = 0.7, 8  # the level of predicted; rows of each label it takes to set it
WINDOW = 12  # words of the short windows that long rows are also trained on
_PAD = max(WIDTHS) - 1

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_ids(buf, off):
    """Buckets of every word (lower-cased A-Z, punctuation at its ends taken
    off) and of its prefixes, a row each, and the words' documents. A prefix
    longer than the word has the neutral bucket."""
    low = tx.lower(buf)
    start, end, doc = tx.words(low, off)
    for _ in range(4):
        start = start + (_PUNCT[low[start]] & (end - start > 1))
        end = end - (_PUNCT[low[end - 1]] & (end - start > 1))
    parts = [tx.span_hash(low, start, end) % np.uint64(BUCKETS)]
    for k in PREFIXES:
        cut = np.minimum(start + k, end)
        h = (tx.span_hash(low, start, cut) + np.uint64(k)) % np.uint64(BUCKETS)
        h[end - start < k] = BUCKETS
        parts.append(h)
    return np.stack(parts, axis=1).astype(np.int32), doc


def _padded(ids, doc, n):
    """Ids with ``_PAD`` neutral rows after each document, and each document's
    first place and number of words."""
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count + _PAD)[:-1]]).astype(np.int64)
    out = np.full((int(count.sum()) + _PAD * n, 1 + len(PREFIXES)), BUCKETS, np.int32)
    seen = np.concatenate([[0], np.cumsum(count)[:-1]])
    out[np.arange(len(ids)) - seen[doc] + first[doc]] = ids
    return out, first, count


def _pool(z, first, count):
    """Maximum of z over each document's places; 0 for a document of none."""
    out = np.zeros((len(first), z.shape[1]), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        at = np.stack([first[some], first[some] + count[some]], axis=1).ravel()
        z = np.concatenate([z, np.zeros((1, z.shape[1]), np.float32)])
        out[some] = np.maximum.reduceat(z, at, axis=0)[::2]
    return out


class Model:
    """Weights: emb [BUCKETS + 1, DIM], conv {width: [width, DIM, FILTERS]},
    bias of each filter, and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.emb[BUCKETS] = 0
        self.conv = {w: (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.shift = np.float32(0)
        self.threshold: dict[str, float] = {}
        self.trained = False

    def responses(self):
        return {w: [self.emb @ self.conv[w][j] for j in range(w)] for w in WIDTHS}

    def pooled(self, ids, first, count, tables):
        parts = []
        m = len(ids)
        # each different word once: the slice's own table of responses
        key = np.zeros(m, np.uint64)
        for k in range(ids.shape[1]):
            key = key * np.uint64(BUCKETS + 1) + ids[:, k].astype(np.uint64)
        _, one, place = np.unique(key, return_index=True, return_inverse=True)
        rows = ids[one]
        for w in WIDTHS:
            own = [sum(t[rows[:, k]] for k in range(rows.shape[1])) for t in tables[w]]
            z = own[0][place]
            for j in range(1, w):
                z[:m - j] += own[j][place[j:]]
            z += self.bias[w]
            parts.append(_pool(np.maximum(z, 0, out=z), first, count))
        return np.concatenate(parts, axis=1)

    def probability(self, pooled):
        if not self.trained:
            return np.full(len(pooled), 0.5)
        return 1 / (1 + np.exp(-np.clip((pooled @ self.out + self.shift).astype(np.float64), -60, 60)))

    def train(self, docs: list[np.ndarray], y: np.ndarray):
        """docs: one array of word buckets per document."""
        if not len(y) or y.min() == y.max():
            self.shift = np.float32(0 if not len(y) else (6 if y[0] else -6))
            self.out[:] = 0
            self.trained = bool(len(y))
            return
        pos, neg = (np.zeros(BUCKETS) for _ in range(2))
        for d, t in zip(docs, y, strict=True):
            seen = np.unique(d)
            (pos if t else neg)[seen[seen < BUCKETS]] += 1
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
        odds[pos + neg < MIN_DOCS] = 0
        self.emb[:BUCKETS, 0] = np.clip(odds, -4, 4) / 4
        for w in WIDTHS:
            self.conv[w][:, 0, 0] = 1 / w
        self.out[::FILTERS] = 1
        self.shift = np.float32(-1)
        # a long toxic text holds many such words, a short one perhaps one or
        # two: every longer row also counts as a short window, of a toxic row
        # around its most telling word
        cuts = np.random.default_rng(6)
        weight = np.append(self.emb[:BUCKETS, 0], 0)
        docs, y = list(docs), list(y)
        for d, t in list(zip(docs, y, strict=True)):
            if len(d) > 2 * WINDOW:
                mid = int(np.argmax(weight[d].sum(axis=1))) if t else int(cuts.integers(len(d)))
                at = max(0, mid - int(cuts.integers(WINDOW)))
                docs.append(d[at:at + WINDOW])
                y.append(t)
        y = np.array(y, np.float32)
        params = [self.emb, *self.conv.values(), *self.bias.values(), self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        sm = sv = 0.0
        rng = np.random.default_rng(5)
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                part = order[s:s + BATCH]
                grads, gshift = self._gradients([docs[i] for i in part], y[part])
                step += 1
                fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    if isinstance(g, tuple):  # rows of the embedding
                        rows, g = g
                        m[rows] = 0.9 * m[rows] + 0.1 * g
                        v[rows] = 0.999 * v[rows] + 0.001 * g * g
                        p[rows] -= RATE * (m[rows] / fix1) / (np.sqrt(v[rows] / fix2) + 1e-8)
                    else:
                        m *= 0.9
                        m += 0.1 * g
                        v *= 0.999
                        v += 0.001 * g * g
                        p -= RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
                sm, sv = 0.9 * sm + 0.1 * gshift, 0.999 * sv + 0.001 * gshift ** 2
                self.shift -= np.float32(RATE * (sm / fix1) / (np.sqrt(sv / fix2) + 1e-8))
        self.trained = True

    def _gradients(self, docs, y):
        n = len(docs)
        ids, first, count = _padded(np.concatenate(docs), np.repeat(np.arange(n), [len(d) for d in docs]), n)
        x = self.emb[ids].sum(axis=1)
        m = len(ids)
        pooled, where = [], []
        owner = np.repeat(np.arange(n), count + _PAD)
        for w in WIDTHS:
            z = x @ self.conv[w][0]
            for j in range(1, w):
                z[:m - j] += x[j:] @ self.conv[w][j]
            z += self.bias[w]
            top = _pool(z, first, count)
            at = np.full((n, FILTERS), -1)
            hit = z == top[owner]
            hit[np.arange(m) - first[owner] >= count[owner]] = False
            r, f = np.nonzero(hit)
            at[owner[r], f] = r  # any of equal maxima
            pooled.append(np.maximum(top, 0))
            where.append(at)
        flat = np.concatenate(pooled, axis=1)
        p = 1 / (1 + np.exp(-np.clip(flat @ self.out + self.shift, -30, 30)))
        d = ((p - y) / n).astype(np.float32)
        g_out = flat.T @ d + 1e-4 * self.out
        g_conv, g_bias, rows, gx = [], [], [], []
        for k, w in enumerate(WIDTHS):
            act = pooled[k]
            up = d[:, None] * self.out[k * FILTERS:(k + 1) * FILTERS] * (act > 0) * (where[k] >= 0)
            gc = np.zeros_like(self.conv[w])
            r, f = np.nonzero(up)
            place, u = where[k][r, f], up[r, f].astype(np.float32)
            for j in range(w):
                np.add.at(gc[j].T, f, u[:, None] * x[place + j])
                for k in range(ids.shape[1]):
                    rows.append(ids[place + j, k])
                    gx.append(u[:, None] * self.conv[w][j][:, f].T)
            g_conv.append(gc + 1e-4 * self.conv[w])
            g_bias.append(up.sum(axis=0).astype(np.float32))
        rows, gx = np.concatenate(rows), np.concatenate(gx)
        keep = rows < BUCKETS
        uniq, inverse = np.unique(rows[keep], return_inverse=True)
        ge = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(ge, inverse, gx[keep])
        return [(uniq, ge), *g_conv, *g_bias, g_out.astype(np.float32)], float(d.sum())

    def scores(self, docs):
        tables = self.responses()
        out = [np.zeros(0)]
        for k in range(0, len(docs), 256):
            part = docs[k:k + 256]
            p = _padded(np.concatenate(part), np.repeat(np.arange(len(part)), [len(d) for d in part]), len(part))
            out.append(self.probability(self.pooled(*p, tables)))
        return np.concatenate(out)

    def learn(self, docs, y, langs):
        """Trains on four rows of five. On the fifth, which it has not seen,
        it sets the level: the best threshold there becomes TOXIC_AT, and each
        language gets its own."""
        fifth = np.arange(len(docs)) % 5 == 4
        if y[fifth].sum() < MIN_LEVEL or (1 - y[fifth]).sum() < MIN_LEVEL:
            self.train(docs, y)
            self.calibrate(self.scores(docs), y, langs)
            return
        self.train([d for d, f in zip(docs, fifth, strict=True) if not f], y[~fifth])
        rest = [d for d, f in zip(docs, fifth, strict=True) if f]
        self.calibrate(self.scores(rest), y[fifth], [])
        low = self.threshold[None]
        self.shift += np.float32(np.log(TOXIC_AT / (1 - TOXIC_AT)) - np.log(low / (1 - low)))
        self.calibrate(self.scores(rest), y[fifth], [x for x, f in zip(langs, fifth, strict=True) if f])

    def calibrate(self, scores, y, langs):
        """For each language the threshold of the best F1 on these rows, half
        way (in log-odds) to the next lower score; the language None has that
        of all rows."""
        for lang in [None, *sorted({x for x in langs if x is not None})]:
            sel = np.array([x == lang for x in langs], bool) if lang is not None else np.ones(len(scores), bool)
            s, t = scores[sel], y[sel]
            if not t.sum():
                continue
            order = np.argsort(-s, kind="stable")
            hit = np.cumsum(t[order])
            f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
            best = int(np.argmax(f1))
            low = s[order][best]
            below = s[s < low]
            ends = np.clip([low, below.max() if len(below) else low / 2], 1e-6, 1 - 1e-6)
            self.threshold[lang] = float(1 / (1 + np.exp(-np.log(ends / (1 - ends)).mean())))


def _sample_job(batches):
    for b in batches:
        for i, j, buf, off in tx.slices(b.column("text")):
            ids, doc = word_ids(buf, off)
            bd = tx.bounds(doc, j - i)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").slice(i, j - i), b.column("label").slice(i, j - i), b.column("lang").slice(i, j - i),
                pa.array([ids[bd[k]:bd[k + 1]].tobytes() for k in range(j - i)], pa.binary())],
                names=["doc_id", "label", "lang", "ids"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Trains on at most ``bound`` labelled rows outside the held-out fold;
    their word buckets (16 bytes a word) come to the driver."""
    ship(docs.sparkSession)
    rows = (training_rows(docs, labels, label, bound, ["lang"]).select("doc_id", "label", "lang", "text")
            .mapInArrow(_sample_job, "doc_id long, label int, lang string, ids binary").toPandas()
            .sort_values("doc_id"))
    ids = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows["ids"]]
    y = rows["label"].to_numpy(np.float32)
    model = Model()
    model.learn(ids, y, [x if isinstance(x, str) else None for x in rows["lang"]])
    return model


def _score_job(shared):
    def run(batches):
        model = shared.value
        tables = getattr(model, "_tables", None)
        if tables is None:
            tables = model._tables = model.responses()
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text"), 1 << 19):
                ids, doc = word_ids(buf, off)
                p = model.probability(model.pooled(*_padded(ids, doc, j - i), tables))
                langs = b.column("lang").slice(i, j - i).to_pylist()
                base = model.threshold.get(None, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(p, pa.float64()),
                     pa.array([model.threshold.get(x, base) for x in langs], pa.float64())],
                    names=["doc_id", "score", "lang_threshold"])
    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: doc_id, held_out,
    score, predicted (score >= 0.7), lang_threshold and flagged (score at
    least the threshold of the row's language, or of all rows for a null or
    unknown one).

    Null, empty and wordless texts get the score of empty pools; without
    labelled rows every score is 0.5. Repeated rows score alike; a null
    doc_id is not held out; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    scored = rows.mapInArrow(_score_job(shared), "doc_id long, score double, lang_threshold double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "lang_threshold",
                         (F.col("score") >= F.col("lang_threshold")).cast("int").alias("flagged"))
