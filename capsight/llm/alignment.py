"""Alignment of two tokenizers over a corpus: which ids of one stand for the
same stretch of text as which ids of the other, and how many documents show it.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both
end at one byte the text falls into groups; every A token of a group is linked
with every B token of it. Most groups hold one token of each, and then both have
the same bytes: an array from A id to the B id of the same bytes, made once from
the vocabularies, names the pair, and how many documents hold it is counted in
one vector as long as the vocabulary. Only the pairs of the other groups go
through a shuffle as pairs.

1. ``align`` tokenizes once and writes each document's groups, digest and its
   distinct linked pairs with their multiplicity.
2. Documents per pair: a vector a task for same-bytes pairs, summed by A id;
   (a, b, count) rows, added up in the task first, for the rest.
3. Scores: same-bytes pairs are looked up in the vector. Of the other pairs the
   commonest, at most ``HOT_PAIRS``, are looked up in a broadcast array; links
   of rarer pairs are joined with the counts by pair, so no key of that join is
   common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.common import drop_staged, ship, stage
from capsight.llm.text import bounds, slices
from capsight.llm.vocab import TokenBytes, byte_level_tokens, piece_tokens, spread

HOT_PAIRS = 1_000_000  # pairs that are broadcast: 16 bytes each
_WHOLE_GROUP = 4096    # links of a group up to which its occurrences are spelled out
_PENDING = 2_000_000   # pairs a task holds before it adds them up

_CACHE: dict = {}


class Aligner:
    """Both tokenizers and their vocabularies as bytes. Special tokens'
    strings in a text are plain text."""

    def __init__(self, spec: str, model: bytes):
        import tiktoken
        from public_tokenizers import PATTERN
        from sentencepiece import SentencePieceProcessor

        tokens = byte_level_tokens(spec)
        self.b_model = SentencePieceProcessor(model_proto=model)
        pieces = piece_tokens(self.b_model)
        self.a, self.b = TokenBytes(tokens), TokenBytes(pieces)
        self.n_a, self.n_b = len(tokens), len(pieces)
        from tokenizers import Tokenizer
        added = set(Tokenizer.from_str(spec).get_added_tokens_decoder())
        self.a_model = tiktoken.Encoding("a", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            t: i for i, t in enumerate(tokens) if i not in added})
        plain = {}
        for i, p in enumerate(pieces):  # a piece goes before the byte that spells the same
            if not (self.b_model.is_control(i) or self.b_model.is_unknown(i)) and (
                    p not in plain or self.b_model.is_byte(plain[p])):
                plain[p] = i
        self.twin = np.array([plain.get(t, -1) for t in tokens], np.int64)
        width = max(self.n_a, self.n_b)
        self.width = width
        self.written = [f"{i}{end}" for end in ",|;" for i in range(width)]

    def encode(self, texts: list[str]):
        """(ids of A, A tokens by text, ids of B, B tokens by text) of those
        texts whose tokens join to a space and the text, and their places."""
        spaced = [" " + t for t in texts]
        ids = [self.a_model.encode_ordinary(t) for t in spaced], self.b_model.encode(texts, num_threads=1)
        want = [np.frombuffer(t.encode(), np.uint8) for t in spaced]
        keep = np.array([bool(t) for t in texts], bool)
        for side, vocab in zip(ids, (self.a, self.b), strict=True):
            flat = np.array([i for x in side for i in x], np.int64)
            count = np.array([len(x) for x in side], np.int64)
            cut = np.concatenate([[0], np.cumsum(vocab.length[flat])])
            size = np.diff(cut[np.concatenate([[0], np.cumsum(count)])])
            same = keep & (size == [len(w) for w in want])
            if same.any():
                rows = np.flatnonzero(same)
                joined = vocab.join(flat[np.repeat(same, count)])
                off = np.concatenate([[0], np.cumsum(size[rows])])
                wrong = joined != np.concatenate([want[r] for r in rows])
                same[rows] = np.diff(np.concatenate([[0], np.cumsum(wrong)])[off]) == 0
            keep &= same
        rows = np.flatnonzero(keep)
        flat = [np.array([i for r in rows for i in side[r]], np.int64) for side in ids]
        count = [np.array([len(side[r]) for r in rows], np.int64) for side in ids]
        return rows, flat[0], count[0], flat[1], count[1]

    def align(self, texts: list[str]) -> dict:
        """Per text the counts, the digest of its groups, and its distinct
        pairs: A ids of same-bytes pairs and (A, B) of the others, each with
        the number of links."""
        n = len(texts)
        rows, a, count_a, b, count_b = self.encode(texts)
        doc_a = np.repeat(rows, count_a)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        # every text ends a token on both sides, so each end has a place
        at = np.searchsorted(end_b, end_a)
        cut_a = end_b[at] == end_a if len(a) else np.zeros(0, bool)
        cut_b = np.zeros(len(b), bool)
        cut_b[at[cut_a]] = True
        in_a, in_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        size_a, size_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        doc = doc_a[cut_a]
        out = {
            "n_a": np.bincount(rows, count_a, n).astype(np.int64), "n_b": np.bincount(rows, count_b, n).astype(np.int64),
            "n_groups": np.bincount(doc, minlength=n), "n_links": np.bincount(doc, size_a * size_b, n).astype(np.int64),
            "groups_sha256": self.digests(n, rows, a, b, cut_a, cut_b, in_a, in_b, first_b, first_a + size_a,
                                          count_a + count_b),
        }
        links = size_a * size_b
        one = np.flatnonzero(links == 1)
        pair_a, pair_b, owner = [a[first_a[one]]], [b[first_b[one]]], [doc[one]]
        times = [np.ones(len(one), np.int64)]
        some = np.flatnonzero((links > 1) & (links <= _WHOLE_GROUP))
        if len(some):
            within = spread(np.zeros(len(some), np.int64), links[some])
            wide = np.repeat(size_b[some], links[some])
            pair_a.append(a[np.repeat(first_a[some], links[some]) + within // wide])
            pair_b.append(b[np.repeat(first_b[some], links[some]) + within % wide])
            owner.append(np.repeat(doc[some], links[some]))
            times.append(np.ones(len(within), np.int64))
        for g in np.flatnonzero(links > _WHOLE_GROUP):  # distinct ids only, with their counts
            x, cx = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            y, cy = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
            pair_a.append(np.repeat(x, len(y)))
            pair_b.append(np.tile(y, len(x)))
            owner.append(np.full(len(x) * len(y), doc[g]))
            times.append(np.outer(cx, cy).ravel())
        pair_a, pair_b, owner = np.concatenate(pair_a), np.concatenate(pair_b), np.concatenate(owner)
        key, where = np.unique((owner * self.n_a + pair_a) * self.n_b + pair_b, return_inverse=True)
        times = np.bincount(where, np.concatenate(times), len(key)).astype(np.int64)
        owner, pair = np.divmod(key, self.n_a * self.n_b)
        pair_a, pair_b = np.divmod(pair, self.n_b)
        twin = self.twin[pair_a] == pair_b
        out["same"] = owner[twin], pair_a[twin], times[twin]
        out["other"] = owner[~twin], pair_a[~twin], pair_b[~twin], times[~twin]
        return out

    def digests(self, n, rows, a, b, cut_a, cut_b, in_a, in_b, start_b, end_a, count):
        """Hex SHA-256 of ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + start_b[in_a]] = a + self.width * cut_a
        order[np.arange(len(b)) + end_a[in_b]] = b + 2 * self.width * cut_b
        written = [self.written[i] for i in order.tolist()]
        out, at = [""] * n, 0
        for r, c in zip(rows.tolist(), count.tolist(), strict=True):
            out[r] = hashlib.sha256("".join(written[at:at + c])[:-1].encode()).hexdigest()
            at += c
        return out


def _aligner(key: str, spec, model) -> Aligner:
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Aligner(spec.value, model.value)
    return _CACHE[key]


def _lists(owner, n, *values):
    off = pa.array(bounds(owner, n), pa.int32())
    return [pa.ListArray.from_arrays(off, pa.array(v, pa.int32())) for v in values]


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "same array<int>, same_n array<int>, other_a array<int>, other_b array<int>, other_n array<int>")


def _align_job(key, spec, model):
    def run(batches):
        aligner = _aligner(key, spec, model)
        for batch in batches:
            for i, j, _, _ in slices(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                r = aligner.align(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i)]
                    + [pa.array(r[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                    + _lists(r["same"][0], j - i, *r["same"][1:]) + _lists(r["other"][0], j - i, *r["other"][1:]),
                    names=[c.split()[0] for c in ALIGNED.split(", ")])
    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, the A ids of its same-bytes pairs (``same``) and its
    other pairs (``other_a``, ``other_b``), each distinct pair with its number of
    links (``same_n``, ``other_n``).

    ``a_path`` is a byte-level BPE in ``tokenizers`` JSON, ``b_path`` a
    sentencepiece model. A text that is null, empty, or that either tokenizer
    does not give back byte by byte has zeros, '' and empty lists. Rows that
    repeat a doc_id are rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    key, spec, model = _models(spark, a_path, b_path)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_align_job(key, spec, model), ALIGNED))


def _models(spark: SparkSession, a_path: str | None, b_path: str | None):
    """The two vocabulary files as broadcasts (a few MB each), and their digest."""
    import public_tokenizers
    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    return key, spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(model)


def _vector_job(batches):
    """One vector a task: in how many of its documents each A id stands with
    the B id of its bytes."""
    total = np.zeros(0, np.int64)
    for b in batches:
        c = np.bincount(b.column("same").flatten().to_numpy())
        if len(c) > len(total):
            total, c = c, total
        total[:len(c)] += c
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["a", "n"])


def _pairs_job(batches):
    """(a, b, documents) of the task's other pairs, added up before they leave."""
    held, size = [], 0

    def flush():
        key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(where, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)

    def rows(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()),
                                           pa.array(n)], names=["a", "b", "n"])

    for b in batches:
        x, y = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("other_a", "other_b"))
        held.append((x << 32 | y, np.ones(len(x), np.int64)))
        size += len(x)
        if size > _PENDING:
            held = [flush()]
            size = len(held[0][0])
            if size > _PENDING // 2:
                yield rows(*held[0])
                held, size = [], 0
    if held:
        yield rows(*flush())


SCORED = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, rare array<struct<a:int,b:int,n:int>>")


def _score_job(same_n, best, hot):
    """Adds up the counts of each document's links; links of pairs that are not
    in ``hot`` are handed on."""
    def run(batches):
        vector, top, (keys, counts) = same_n.value, best.value, hot.value
        for b in batches:
            n = b.num_rows
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def lists(*names, b=b):
                off = b.column(names[0]).value_lengths().fill_null(0).to_numpy()
                return np.repeat(np.arange(b.num_rows), off), *(b.column(c).flatten().to_numpy().astype(np.int64) for c in names)

            def add(doc, a, count, times, sums=sums, bests=bests):
                np.add.at(sums, doc, count * times)
                np.add.at(bests, doc, np.where(count == top[a], times, 0))

            doc, a, times = lists("same", "same_n")
            add(doc, a, vector[a], times)
            doc, a, x, times = lists("other_a", "other_b", "other_n")
            key = a << 32 | x
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            add(doc[known], a[known], counts[at[known]], times[known])
            left = ~known
            rare = pa.StructArray.from_arrays([pa.array(v[left], pa.int32()) for v in (a, x, times)], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
                + [pa.array(bests), pa.array(sums), b.column("groups_sha256"),
                   pa.ListArray.from_arrays(pa.array(bounds(doc[left], n), pa.int32()), rare)],
                names=["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare"])
    return run


def _dense(rows, value: str, least: int = 1) -> np.ndarray:
    """A vector by A id from (a, value) rows: no longer than the vocabulary."""
    got = rows.toArrow()
    ids, n = got["a"].to_numpy(), got[value].to_numpy()
    out = np.zeros(max(least, int(ids.max()) + 1 if len(ids) else 0), np.int64)
    out[ids] = n
    return out


def corpus_pairs(aligned: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Documents per pair of ``aligned``: by A id for same-bytes pairs (a vector
    as long as the vocabulary), and (a, b, n) of all others."""
    same = aligned.select("same").mapInArrow(_vector_job, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))
    other = (aligned.select("other_a", "other_b").mapInArrow(_pairs_job, "a int, b int, n long")
             .groupBy("a", "b").agg(F.sum("n").alias("n")))
    return _dense(same, "n"), stage(other, "pairs")


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None,
           hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links
    whose pair is in as many documents as any pair of its A id, ties included),
    count_sum (documents of each link's pair, added up over links) and
    groups_sha256. For rows without tokens see :func:`align`; an empty table
    gives no rows. ``hot_pairs`` bounds what is broadcast, not the result.
    """
    spark = docs.sparkSession
    aligned = stage(align(docs, a_path, b_path).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    vector, pairs = corpus_pairs(aligned)
    best = _dense(pairs.groupBy("a").agg(F.max("n").alias("n")), "n", len(vector))
    vector = np.concatenate([vector, np.zeros(len(best) - len(vector), np.int64)])
    best = np.maximum(best, vector)
    # the commonest pairs, as many whole classes of like count as the bound holds
    rank = F.floor(F.log2("n") * 8)
    classes = sorted(pairs.groupBy(rank.alias("r")).count().collect(), key=lambda r: -r["r"])
    held, least, rest = 0, None, False
    for c in classes:
        held += c["count"]
        if held > hot_pairs:
            rest = True
            break
        least = c["r"]
    if least is None:
        hot = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        got = pairs.filter(rank >= least).select(
            F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("k"), "n").toArrow()
        key, n = got["k"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(key)
        hot = key[order], n[order]
    send = spark.sparkContext.broadcast
    scored = aligned.mapInArrow(_score_job(send(vector), send(best), send(hot)), SCORED)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not rest:  # every pair was looked up
        return scored.select(names)
    scored = stage(scored, "scored")
    drop_staged(spark, aligned)
    rare = pairs if least is None else pairs.filter(rank < least)
    top = spark.createDataFrame([(int(i), int(best[i])) for i in np.flatnonzero(best)], "a int, top long")
    more = (scored.select("rid", F.inline("rare")).withColumnRenamed("n", "times")
            .join(rare, ["a", "b"]).join(F.broadcast(top), "a")
            .groupBy("rid").agg(F.sum(F.col("n") * F.col("times")).alias("sum_r"),
                                F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best_r")))
    zero = F.lit(0).cast("long")
    return (scored.drop("rare").join(more, "rid", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("best_r", zero))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_r", zero)).select(names))
