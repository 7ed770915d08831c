"""Approximate nearest neighbours by inner product: NN-descent and greedy
graph search.

A neighbour graph over all vectors starts from cells around pivots (hot cells
are split into blocks) and is improved by rounds of NN-descent: every node
gathers its neighbours and some of the nodes that hold it as a neighbour,
compares them with one another, and proposes to each the best of the others.
The rounds end when one of them renews at most the share ``SETTLED`` of the
lists' entries. A node that no block gave a neighbour starts from the nearest
pivots.
A query walks the finished graph: its ``EF`` best nodes so far are expanded,
``STEP`` at a time, until none of them is left to expand. All queries walk at
once, a round of theirs being one join with the graph.

Equal vectors are one node, whose smallest ids answer for it. Graph and walk
use half-precision copies of the vectors, each divided by its own largest
component, which goes along as a float32; so a few very long or short vectors
cost the others no precision. A score in a node's list leaves out the node's
own factor, which changes no order. The best ``POOL`` found are scored again in
double precision on the original vectors.

Bounds: at most ``MAX_PIVOTS`` pivots go to every task; a node has ``K``
neighbours, and takes part in at most ``2 * SAMPLE`` memberships a round. A
batch of the walk holds about ``BATCH_MB`` whatever the vectors' length, and
rows meet the pivots ``PIVOT_CELLS`` similarities at a time.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm.common import drop_staged, ship, stage, whole_groups
from capsight.llm.text import mix

K, SAMPLE, PROPOSE = 24, 16, 6
SETTLED = 0.05
MAX_PIVOTS, CELLS, BLOCK = 4096, 3, 512
EF, STEP, REVERSE, POOL = 640, 80, 48, 48
BATCH_MB, PIVOT_CELLS = 4, 1 << 20


@contextmanager
def small_batches(spark, row_bytes: int):
    """Within the block the jobs that start hand rows of about ``row_bytes`` to
    Python, and keep them, in batches of about BATCH_MB (10,000 rows by
    default, however long they are)."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.inMemoryColumnarStorage.batchSize")
    before = {c: spark.conf.get(c) for c in names}
    rows = max(1, BATCH_MB * 1_000_000 // row_bytes)
    try:
        for c, v in before.items():
            # 0 or less: no limit
            spark.conf.set(c, str(min(int(v), rows) if int(v) > 0 else rows))
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def _pieces(batches, width: int):
    """The batches in pieces of about PIVOT_CELLS / width rows."""
    rows = max(1, PIVOT_CELLS // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _joined(column) -> bytes:
    return b"".join(column.to_pylist())


def _ragged(column, dtype):
    """All values of a binary column end to end, and each row's number."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), dtype)
    return flat, np.array([len(r) for r in rows], np.int64) // np.dtype(dtype).itemsize


def top_lists(owner, other, score, k):
    """Per owner its k best different others, best first (ties: smaller
    other): (owners, bounds, others, scores)."""
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    # an other may come with one score only, so equal ones lie side by side
    # up to rounding; the first is kept
    pair = np.lexsort((np.arange(len(owner)), other, owner))
    same = np.zeros(len(owner), bool)
    same[pair[1:]] = (owner[pair[1:]] == owner[pair[:-1]]) & (other[pair[1:]] == other[pair[:-1]])
    owner, other, score = owner[~same], other[~same], score[~same]
    u, first, count = np.unique(owner, return_index=True, return_counts=True)
    rank = np.arange(len(owner)) - np.repeat(first, count)
    keep = rank < k
    b = np.concatenate([[0], np.cumsum(np.minimum(count, k))])
    return u, b, other[keep], score[keep]


_LIST = "node long, ids binary, scores binary"


def _list_batch(u, b, ids, scores, name="node"):
    return pa.RecordBatch.from_arrays([
        pa.array(u, pa.int64()),
        pa.array([ids[b[i]:b[i + 1]].astype(np.int64).tobytes() for i in range(len(u))], pa.binary()),
        pa.array([scores[b[i]:b[i + 1]].astype(np.float32).tobytes() for i in range(len(u))], pa.binary())],
        names=[name, "ids", "scores"])


def _half(scale):
    """v: a vector's largest component in units of ``scale`` (float32; beyond
    1e30 or below 1e-30 it counts as that), then the shares of it (float16)."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                top = np.abs(v).max(axis=1)
                with np.errstate(over="ignore"):
                    factor = np.clip(top / scale, 1e-30, 1e30).astype(np.float32)
                v = (v / top[:, None]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.array([f.tobytes() + r.tobytes() for f, r in zip(factor, v, strict=True)],
                                                pa.binary())], names=["node", "v"])
    return run


def _unpack(raw, n):
    """(shares, factors) of n vectors end to end."""
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return rows[:, 4:].copy().view(np.float16).astype(np.float32), rows[:, :4].copy().view(np.float32)[:, 0]


def _vectors(column, n):
    return _unpack(_joined(column), n)


def _cell_job(pivots, cells):
    def run(batches):
        for b in _pieces(batches, len(pivots)):
            n = b.num_rows
            sim = _vectors(b.column("v"), n)[0] @ pivots.T
            k = min(cells, sim.shape[1])
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.ravel().astype(np.int64)), b.column("node").take(pa.array(row)),
                 b.column("v").take(pa.array(row))], names=["cell", "node", "v"])
    return run


def _block_job(batches):
    """Neighbours within blocks. A block holds about BLOCK rows by a hash of
    the node; a larger one is taken in pieces."""
    for t in whole_groups(batches, "block"):
        blocks, node = t["block"].to_numpy(), t["node"].to_numpy()
        v, factor = _vectors(t["v"], len(node))
        edges = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        for lo, hi in zip(edges, [*edges[1:], len(node)], strict=True):
            for s in range(lo, hi, 2 * BLOCK):
                e = min(hi, s + 2 * BLOCK)
                if e - s < 2:
                    continue
                sim = v[s:e] @ v[s:e].T * factor[s:e]
                np.fill_diagonal(sim, -np.inf)
                k = min(K, e - s - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(sim, best, axis=1)
                yield _list_batch(node[s:e], np.arange(0, (e - s + 1) * k, k), node[s:e][best].ravel(), score.ravel())


def _merge_job(k):
    def run(batches):
        for t in whole_groups(batches, "node"):
            ids, n = _ragged(t["ids"], np.int64)
            scores, _ = _ragged(t["scores"], np.float32)
            owner = np.repeat(t["node"].to_numpy(), n)
            if len(owner):
                yield _list_batch(*top_lists(owner, ids, scores, k))
    return run


def _merged(lists: DataFrame, k: int = K) -> DataFrame:
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (lists.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_merge_job(k), _LIST))


def _renew_job(k):
    """Lists (``old``) and proposals brought together; ``new`` counts the
    entries of a list that it did not hold before."""
    def run(batches):
        for t in whole_groups(batches, "node"):
            ids, n = _ragged(t["ids"], np.int64)
            scores, _ = _ragged(t["scores"], np.float32)
            owner = np.repeat(t["node"].to_numpy(), n)
            if not len(owner):
                continue
            u, b, other, score = top_lists(owner, ids, scores, k)
            row = np.repeat(np.arange(len(u)), np.diff(b))
            held = np.repeat(t["old"].to_numpy(zero_copy_only=False), n)
            known = np.isin(_pair_hash(u[row], other), _pair_hash(owner[held], ids[held]))
            new = np.bincount(row, weights=~known, minlength=len(u)).astype(np.int32)
            out = _list_batch(u, b, other, score)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(new)], names=[*out.schema.names, "new"])
    return run


def _pair_hash(a, b):
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64))


def _lone_job(ids, pivots, factor):
    """Lists of the nearest pivots (the nodes ``ids``)."""
    def run(batches):
        for b in _pieces(batches, len(pivots)):
            n = b.num_rows
            node = b.column("node").to_numpy()
            sim = _vectors(b.column("v"), n)[0] @ pivots.T * factor
            row, col = np.nonzero(node[:, None] != ids)
            if len(row):
                yield _list_batch(*top_lists(node[row], ids[col], sim[row, col], K))
    return run


def _edge_job(batches):
    """(center, member, floor): every node with its SAMPLE best neighbours as
    members, and itself as a member of theirs. floor is the member's worst
    score, below which it wants no proposal (it is known where the node
    itself is the member)."""
    for b in batches:
        node = b.column("node").to_numpy()
        rows_i, rows_s = b.column("ids").to_pylist(), b.column("scores").to_pylist()
        center, member = [], []
        for u, i, s in zip(node, rows_i, rows_s, strict=True):
            best = np.frombuffer(i, np.int64)[:SAMPLE]
            center += [np.full(len(best), u), best]
            member += [best, np.full(len(best), u)]
        if center:
            kind = np.concatenate([np.full(len(c), j % 2, np.int32) for j, c in enumerate(center)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(center)), pa.array(np.concatenate(member)),
                                              pa.array(kind)], names=["center", "member", "back"])


def _local_job(batches):
    """All members of a center against one another; each gets the PROPOSE
    best of the others. Rows come in order of center and member, and equal ones
    are one member."""
    for t in whole_groups(batches, "center"):
        center, member = t["center"].to_numpy(), t["member"].to_numpy()
        first = np.ones(len(member), bool)
        first[1:] = (center[1:] != center[:-1]) | (member[1:] != member[:-1])
        t, center, member = t.filter(pa.array(first)), center[first], member[first]
        floor = t["floor"].to_numpy()
        v, factor = _vectors(t["v"], len(member))
        edges = np.flatnonzero(np.diff(center, prepend=center[0] - 1))
        owner, other, score = [], [], []
        for lo, hi in zip(edges, [*edges[1:], len(member)], strict=True):
            if hi - lo < 2:
                continue
            sim = v[lo:hi] @ v[lo:hi].T * factor[lo:hi]
            m = member[lo:hi]
            sim[m[:, None] == m[None, :]] = -np.inf
            k = min(PROPOSE, hi - lo - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sim, best, axis=1)
            ok = s > floor[lo:hi, None]
            owner.append(np.broadcast_to(m[:, None], s.shape)[ok])
            other.append(m[best][ok])
            score.append(s[ok])
        if owner and sum(map(len, owner)):
            yield _list_batch(*top_lists(np.concatenate(owner), np.concatenate(other), np.concatenate(score), K))


def build_graph(vectors: DataFrame, settled: float = SETTLED) -> DataFrame:
    """(node, ids, scores): the K best neighbours known of every node of
    ``vectors(node, v)``, best first; an only node is not returned. ``settled``
    is the share of renewed entries at which the rounds end."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = vectors.count()
    p = int(min(MAX_PIVOTS, max(1, total ** 0.5)))
    rows = vectors.orderBy(F.xxhash64("node"), "node").limit(p).select("node", "v").collect()
    at_pivots, factor = _unpack(b"".join(r["v"] for r in rows), len(rows))
    pivots = at_pivots / np.linalg.norm(at_pivots, axis=1, keepdims=True)  # a long pivot draws no more nodes than another
    cells = stage(vectors.mapInArrow(_cell_job(pivots, CELLS), "cell long, node long, v binary"), "cells")
    sizes = F.broadcast(cells.groupBy("cell").count())  # one row for each of at most MAX_PIVOTS cells
    blocks = (cells.join(sizes, "cell")
              .withColumn("block", F.col("cell") * (1 << 32)
                          + F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("count") / BLOCK).cast("long")))
              .select("block", "node", "v").repartition(n, "block").sortWithinPartitions("block", "node"))
    graph = stage(_merged(blocks.mapInArrow(_block_job, _LIST)), "graph")
    drop_staged(spark, cells)
    lone = vectors.join(graph.select("node"), "node", "left_anti")
    lone = stage(lone.mapInArrow(_lone_job(np.array([r["node"] for r in rows], np.int64), at_pivots, factor), _LIST), "graph")
    first, graph = graph, graph.union(lone)
    staged = [first, lone]
    while True:
        edges = graph.mapInArrow(_edge_job, "center long, member long, back int")
        w = Window.partitionBy("center", "back").orderBy(F.xxhash64("center", "member"), "member")
        # a node's own SAMPLE best all stay; a member that comes both ways counts once (_local_job)
        edges = edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).select("center", "member")
        # a node's worst score: the last of its list, if that is full
        worst = graph.mapInArrow(_floor_job, "member long, floor float")
        data = vectors.withColumnRenamed("node", "member").join(worst, "member", "left").fillna(-3e38, ["floor"])
        met = (edges.join(data, "member").repartition(n, "center").sortWithinPartitions("center", "member")
               .select("center", "member", "floor", "v"))
        proposed = met.mapInArrow(_local_job, _LIST)
        both = (graph.withColumn("old", F.lit(True)).union(proposed.withColumn("old", F.lit(False)))
                .repartition(n, "node").sortWithinPartitions("node"))
        nxt = stage(both.mapInArrow(_renew_job(K), _LIST + ", new int"), "graph")
        drop_staged(spark, *staged)
        graph, staged = nxt.drop("new"), [nxt]
        renewed = nxt.agg(F.sum("new")).first()[0] or 0
        if renewed <= settled * K * total:
            return graph


def _floor_job(batches):
    for b in batches:
        last = []
        for s in b.column("scores").to_pylist():
            x = np.frombuffer(s, np.float32)
            last.append(float(x[-1]) if len(x) >= K else -3e38)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(last, pa.float32())], names=["member", "floor"])


def _pack_job(batches):
    """One row per node: its neighbours' ids and vectors."""
    for t in whole_groups(batches, "node"):
        node, other, v = t["node"].to_numpy(), t["other"].to_numpy(), t["v"].to_pylist()
        edges = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
        ends = [*edges[1:], len(node)]
        yield pa.RecordBatch.from_arrays([
            pa.array(node[edges]),
            pa.array([other[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()),
            pa.array([b"".join(v[a:b]) for a, b in zip(edges, ends, strict=True)], pa.binary())],
            names=["node", "nids", "nvecs"])


def _adjacency(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """Both directions of the graph's edges, at most REVERSE of those coming
    in, with the vectors at their ends."""
    n = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = graph.mapInArrow(_out_job, "node long, other long")
    back = out.select(F.col("other").alias("node"), F.col("node").alias("other"))
    w = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"), "other")
    back = back.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= REVERSE).select("node", "other")
    both = out.union(back).distinct().join(vectors.withColumnRenamed("node", "other"), "other")
    return (both.select("node", "other", "v").repartition(n, "node").sortWithinPartitions("node", "other")
            .mapInArrow(_pack_job, "node long, nids binary, nvecs binary"))


def _out_job(batches):
    for b in batches:
        ids, n = _ragged(b.column("ids"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), n)), pa.array(ids)],
                                         names=["node", "other"])


_STATE = "node long, v binary, ids binary, scores binary, done binary"


def _next(scores, done, ef, step):
    """Places of the ``step`` best not yet expanded among the ``ef`` best; the
    lists are best first."""
    return np.flatnonzero(~done[:ef])[:step]


def _frontier_job(ef, step):
    def run(batches):
        for b in batches:
            q, at, vec, floor = [], [], [], []
            for node, v, ids, s, d in zip(*(b.column(c).to_pylist() for c in ("node", "v", "ids", "scores", "done")),
                                          strict=True):
                ids, s, d = np.frombuffer(ids, np.int64), np.frombuffer(s, np.float32), np.frombuffer(d, bool)
                pick = _next(s, d, ef, step)
                low = float(s[ef - 1]) if len(s) >= ef else -3e38
                q += [node] * len(pick)
                at += ids[pick].tolist()
                vec += [v] * len(pick)
                floor += [low] * len(pick)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(q, pa.int64()),
                                              pa.array(vec, pa.binary()), pa.array(floor, pa.float32())],
                                             names=["node", "q", "qv", "floor"])
    return run


def _expand_job(batches):
    for b in batches:
        out_i, out_s, out_q = [], [], []
        for q, qv, floor, ids, vecs in zip(*(b.column(c).to_pylist() for c in ("q", "qv", "floor", "nids", "nvecs")),
                                           strict=True):
            x = _unpack(qv, 1)[0][0]
            i = np.frombuffer(ids, np.int64)
            v, factor = _unpack(vecs, len(i))
            s = v @ x * factor
            ok = (s > floor) & (i != q)
            if ok.any():
                out_q.append(q)
                out_i.append(i[ok].tobytes())
                out_s.append(s[ok].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.binary()),
                                          pa.array(out_s, pa.binary())], names=["node", "ids", "scores"])


def _state_job(ef, step):
    """A query's state and its finds, brought together: the nodes just
    expanded are marked, the new ones merged, the ef best kept."""
    def run(batches):
        for t in whole_groups(batches, "node"):
            node = t["node"].to_numpy()
            edges = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
            cols = [t[c].to_pylist() for c in ("v", "ids", "scores", "done")]
            rows = []
            for lo, hi in zip(edges, [*edges[1:], len(node)], strict=True):
                own = next(i for i in range(lo, hi) if cols[0][i] is not None)
                ids, s = np.frombuffer(cols[1][own], np.int64), np.frombuffer(cols[2][own], np.float32)
                done = np.frombuffer(cols[3][own], bool).copy()
                done[_next(s, done, ef, step)] = True
                rest = [i for i in range(lo, hi) if i != own]
                new_i = np.concatenate([ids, *[np.frombuffer(cols[1][i], np.int64) for i in rest]])
                new_s = np.concatenate([s, *[np.frombuffer(cols[2][i], np.float32) for i in rest]])
                new_d = np.concatenate([done, np.zeros(len(new_i) - len(ids), bool)])
                _, first = np.unique(new_i, return_index=True)  # the state's own entries come first
                order = first[np.lexsort((new_i[first], -new_s[first]))][:ef]
                rows.append((node[lo], cols[0][own], new_i[order].tobytes(), new_s[order].tobytes(),
                             new_d[order].tobytes()))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *[pa.array(x, pa.binary()) for x in c[1:]]],
                                             names=["node", "v", "ids", "scores", "done"])
    return run


def _start_job(batches):
    for b in batches:
        done = [bytes(len(x) // 8) for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("node", "v", "ids", "scores")],
                                          pa.array(done, pa.binary())], names=["node", "v", "ids", "scores", "done"])


def walk(starts: DataFrame, graph: DataFrame, vectors: DataFrame, ef: int = EF, step: int = STEP) -> DataFrame:
    """(node, v, ids, scores, done): for every node of ``starts(node)`` the ef
    best nodes found by greedy search from its own neighbours. A row of the
    walk holds the vectors of up to K + REVERSE neighbours."""
    spark = graph.sparkSession
    width = vectors.agg(F.max(F.octet_length("v"))).first()[0] or 0
    with small_batches(spark, (K + REVERSE) * (width + 8)):
        return _walk(starts, graph, vectors, ef, step)


def _walk(starts: DataFrame, graph: DataFrame, vectors: DataFrame, ef: int, step: int) -> DataFrame:
    spark = graph.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = stage(_adjacency(graph, vectors), "adjacency")
    # kept by node in the executors: every round joins it without moving it;
    # a lost part is read again from the staged table
    near = near.repartition(n, "node").persist()
    state = stage(starts.join(graph, "node").join(vectors, "node").select("node", "v", "ids", "scores")
                  .mapInArrow(_start_job, _STATE), "walk")
    while True:
        frontier = state.mapInArrow(_frontier_job(ef, step), "node long, q long, qv binary, floor float")
        found = (frontier.repartition(n, "node").join(near.hint("shuffle_hash"), "node")
                 .select("q", "qv", "floor", "nids", "nvecs").mapInArrow(_expand_job, _LIST))
        found = found.select("node", F.lit(None).cast("binary").alias("v"), "ids", "scores",
                             F.lit(None).cast("binary").alias("done"))
        nxt = stage(state.union(found).repartition(n, "node").sortWithinPartitions("node")
                    .mapInArrow(_state_job(ef, step), _STATE), "walk")
        drop_staged(spark, state)
        state = nxt
        left = state.mapInArrow(_left_job(ef), "n long").agg(F.sum("n")).first()[0]
        if not left:
            break
    near.unpersist()
    return state


def _left_job(ef):
    def run(batches):
        for b in batches:
            n = sum(int((~np.frombuffer(d, bool)[:ef]).sum()) for d in b.column("done").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
    return run


def _best_job(pool):
    def run(batches):
        for b in batches:
            rows = [x[:8 * pool] for x in b.column("ids").to_pylist()]
            n = [len(x) // 8 for x in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(b.column("node").to_numpy(), n)),
                pa.array(np.frombuffer(b"".join(rows), np.int64))], names=["a", "b"])
    return run


def _score_job(batches):
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x * y).sum(axis=1))],
                                         names=["a", "b", "score"])


def search(table: DataFrame, every: int = 20, k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``table(vec_id,
    embedding)`` whose vec_id is divisible by ``every``, its k best others by
    inner product, best first, ties to the smaller vec_id.

    Null, zero or non-finite vectors, vectors with null components and of a
    length other than the commonest take no part, nor do rows without a
    vec_id. Of rows that repeat a vec_id the smallest vector counts. Equal
    vectors tie. Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    ship(spark)
    e = F.col("embedding")
    rows = (table.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
            .filter("vec_id is not null and embedding is not null and size(embedding) > 0")
            .filter(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .filter(F.exists(e, lambda x: x != 0)))
    rows = stage(rows.groupBy("vec_id").agg(F.min("embedding").alias("vec")), "vectors")
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if top is None:
        return empty
    rows = rows.filter(F.size("vec") == top["d"])
    # equal vectors: one node, the smallest id
    rep = rows.groupBy("vec").agg(F.min("vec_id").alias("node"))
    nodes = stage(rep, "nodes")
    w = Window.partitionBy("node").orderBy("vec_id")
    member = rows.join(nodes, "vec").select("node", "vec_id")
    scale = nodes.agg(F.percentile_approx(F.array_max(F.transform("vec", lambda x: F.abs(x))), 0.5)).first()[0]
    vectors = stage(nodes.mapInArrow(_half(scale), "node long, v binary"), "half")
    asked = stage(member.filter(F.col("vec_id") % every == 0), "asked")
    graph = build_graph(vectors)
    found = walk(asked.select("node").distinct(), graph, vectors, max(ef, k))
    pairs = found.mapInArrow(_best_job(max(POOL, 2 * k)), "a long, b long")
    pairs = pairs.union(asked.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct())
    data = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", "x", "y"))
    scored = stage(data.mapInArrow(_score_job, "a long, b long, score double"), "scored")
    few = member.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select(F.col("node").alias("b"), "vec_id")
    # one more than k of each node's ids, as the query's own may be among them
    out = (asked.select(F.col("node").alias("a"), F.col("vec_id").alias("query_id"))
           .join(scored, "a").join(few, "b").filter("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
