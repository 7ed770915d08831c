"""MinHash near-duplicate groups by an LSH forest.

Every document's set of word shingles gets ``TREES * DEPTH`` min-hash values.
Tree t of the forest is the list of all documents in the order of their t-th
group of DEPTH values; documents whose values begin alike lie side by side,
and the longest common prefix with a neighbour tells how deep the two stay in
one branch of the tree. A region is a run of documents that share a prefix of
``MIN_DEPTH`` values; a region of more than ``REGION`` documents is taken
apart by longer prefixes, as deep as it needs, and what not even the full
depth separates by windows of the order. All pairs within a region are
compared by small sketches of the signatures, in blocks; the ``BEST`` most
similar partners of each document become candidates.

Candidates are confirmed on the full shingle sets. Where documents have more
similar partners than were taken, their region is compared once more, whole
and on the full sets: a region has at most REGION documents, all pairs of two
components are intersected by blocked matrix products in its task, and only
links that join components leave it. A pair inside a component cannot change
the result, so no link is lost to the bound on partners, and a group of
thousands of near copies costs a few rows per document, never all pairs.

Taking a region apart leaves pairs uncompared, and so do the bounds between
sorted partitions. Such regions are written out whole, and what is still in
different components of one is compared on the full sets: the rows outside its
largest component against all its rows, in blocks of ``REGION`` by ``REGION``
that are spread over the tasks. The regions of one tree come first, then of
two, then of the others, so that the later ones find few rows outside.

Results hold one row per input row. Copies (equal shingle sets) are put
together first by a digest of the set, so only different texts are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm import text as tx
from capsight.llm.common import BROADCAST_IDS, components, drop_staged, merge_components, semi_by_id, ship, stage, whole_groups

TREES, DEPTH, MIN_DEPTH, REGION = 16, 8, 3, 1024
NEAR, BEST, SEAM, BLOCK = 6, 4, 64, 4096
SKETCH_SLACK = 0.16  # below threshold; about four standard errors of the sketch


def _hash_family():
    rng = np.random.default_rng(7)
    n = TREES * DEPTH
    return rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _slice_sets(buf, off, k):
    """Per document the sorted distinct shingle hashes, laid end to end, with
    bounds."""
    low = tx.lower(buf)
    start, end, doc = tx.words(low, off)
    h, owner = tx.shingles(tx.span_hash(low, start, end), doc, len(off) - 1, k)
    b = tx.bounds(owner, len(off) - 1)
    sets = [np.unique(h[b[i]:b[i + 1]]) for i in range(len(off) - 1)]
    return sets


def _signatures(sets, family):
    """uint32 [documents, TREES * DEPTH]; rows of empty sets are zero."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(family)), np.uint32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # short runs of documents keep the working arrays in cache
    first = 0
    while first < len(full):
        last, total = first, 0
        while last < len(full) and (last == first or total + size[full[last]] <= 32768):
            total += size[full[last]]
            last += 1
        part = full[first:last]
        x = np.concatenate([sets[i] for i in part])
        lo, hi = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(size[part])[:-1]])
        for j, a in enumerate(family):
            out[part, j] = np.minimum.reduceat(lo * a + hi, at)
        first = last
    return out


def _sketch(sig):
    """Two bits of each value, packed: 2 * TREES * DEPTH bits a document."""
    n = len(sig)
    top = np.stack([(sig >> np.uint32(7)) & 1, (sig >> np.uint32(19)) & 1], axis=2)
    return np.packbits(top.reshape(n, -1).astype(np.uint8), axis=1)


def _signature_job(k):
    family = _hash_family()

    def run(batches):
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text")):
                sets = _slice_sets(buf, off, k)
                sig = _signatures(sets, family)
                sk = _sketch(sig)
                n = j - i
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(i, n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                              for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in sig.astype(">u4")], pa.binary()),
                    pa.array([r.tobytes() for r in sk], pa.binary()),
                ], names=["doc_id", "n_shingles", "digest", "sig", "sketch"])
    return run


def _tree_job(batches):
    width = DEPTH * 4
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(n, TREES, width)
        for t in range(TREES):
            key = np.empty((n, width + 1), np.uint8)
            key[:, 0] = t
            key[:, 1:] = sig[:, t]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in key], pa.binary()), b.column("node"),
                 b.column("sketch")], names=["key", "node", "sketch"])


def _onehot(sk):
    """Float rows whose product counts the values two sketches agree on."""
    two = np.stack([(sk >> np.uint8(k)) & 3 for k in (6, 4, 2, 0)], axis=2).reshape(len(sk), -1)
    return (two[:, :, None] == np.arange(4, dtype=np.uint8)).reshape(len(sk), -1).astype(np.float32)


def _similar(agree):
    """Estimated similarity from the number of agreeing two-bit values."""
    return (agree / (TREES * DEPTH) - 0.25) / 0.75


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _agree(x, y):
    same = x ^ y
    return TREES * DEPTH - _BITS[(same | (same >> 1)) & 0x55].sum(axis=1, dtype=np.int64)


def _parts(key, lo, hi, depth):
    """Index ranges in which all pairs are compared."""
    if hi - lo <= REGION:
        if hi - lo > 1:
            yield lo, hi
        return
    if depth == DEPTH:
        half = REGION // 2
        for s in range(lo, hi, half):
            if s == lo or hi - s > half:
                yield s, min(hi, s + REGION)
        return
    a, b = 1 + 4 * depth, 5 + 4 * depth
    cut = np.flatnonzero((key[lo + 1:hi, a:b] != key[lo:hi - 1, a:b]).any(axis=1)) + lo + 1
    for s, e in zip([lo, *cut], [*cut, hi], strict=True):
        yield from _parts(key, int(s), int(e), depth + 1)


def _neighbour_job(floor):
    """Reads rows in key order, region by region; yields candidate pairs (kind
    1) and, for documents with more than BEST similar partners, the document
    and its region's id (kind 2). Rows at either end of a partition are also
    put out (kind 0), so that a last pass over these few rows joins what the
    partition cut apart. The documents of a region that is taken apart, or that
    may go on in another partition, are put out with the region's id (kind 3 +
    tree)."""
    width = DEPTH * 4 + 1
    prefix = 1 + 4 * MIN_DEPTH

    def pairs(p, q, node):
        x, y = node[p], node[q]
        return _out(np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int32))

    def small(key, sk, node, near):
        """Regions of at most NEAR + 1 rows, all at once: every pair."""
        for o in range(1, NEAR + 1):
            x = np.flatnonzero(near[o:] & near[:-o] & (key[o:, :prefix] == key[:-o, :prefix]).all(axis=1)) if len(node) > o else []
            if not len(x):
                break
            y = x + o
            ok = _similar(_agree(sk[x], sk[y])) >= floor
            yield pairs(x[ok], y[ok], node)

    def large(key, sk, node, lo, hi):
        for s, e in _parts(key, lo, hi, MIN_DEPTH):
            hot = _onehot(sk[s:e])
            est = _similar(hot @ hot.T)
            np.fill_diagonal(est, -1)
            fit = est >= floor
            many = fit.sum(axis=1)
            rows = np.flatnonzero(many)
            if not len(rows):
                continue
            k = min(BEST, e - s - 1)
            top = np.argpartition(-est[rows], k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(fit[rows], top, axis=1)
            p, q = np.repeat(rows, k)[ok.ravel()], top[ok]
            yield pairs(p + s, q + s, node)
            over = node[s:e][many > BEST]
            name = hashlib.blake2b(key[s].tobytes() + node[s:s + 1].tobytes(), digest_size=8).digest()
            yield _out(over, np.full(len(over), int.from_bytes(name, "big", signed=True)), np.full(len(over), 2, np.int32))

    def regions(key, sk, node, first=False, last=False):
        start = np.flatnonzero(np.append(True, (key[1:, :prefix] != key[:-1, :prefix]).any(axis=1)))
        size = np.diff(np.append(start, len(node)))
        whole = size > REGION
        whole[0] |= first
        whole[-1] |= last
        for lo, m in zip(start[whole], size[whole], strict=True):
            name = hashlib.blake2b(key[lo, :prefix].tobytes(), digest_size=8).digest()
            yield _out(node[lo:lo + m], np.full(m, int.from_bytes(name, "big", signed=True)),
                       np.full(m, 3 + int(key[lo, 0]), np.int32))
        yield from small(key, sk, node, np.repeat(size <= NEAR + 1, size))
        for lo, m in zip(start[size > NEAR + 1], size[size > NEAR + 1], strict=True):
            yield from large(key, sk, node, int(lo), int(lo + m))

    def run(batches):
        rest, head, first = None, 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rows = (np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(n, width),
                    np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(n, -1),
                    b.column("node").to_numpy(zero_copy_only=False))
            if head < SEAM:
                yield _edge_rows(*(x[:SEAM - head] for x in rows))
                head += n
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
            key = rows[0]
            other = np.flatnonzero((key[:, :prefix] != key[-1, :prefix]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last region may go on
            if cut:
                yield from regions(*(x[:cut] for x in rows), first=first)
                first = False
            if len(key) - cut > 8 * REGION:  # it does, for long: its windows overlap
                yield from regions(*(x[cut:] for x in rows))
                cut = len(key) - REGION
            rest = tuple(x[cut:].copy() for x in rows)
        if rest is not None:
            yield _edge_rows(*(x[-SEAM:] for x in rest))
            yield from regions(*rest, first=first, last=True)
    return run


def _region_job(num, den):
    """Links between different components of a region's documents, enough of
    them to join what belongs together."""
    def run(batches):
        for t in whole_groups(batches, "region"):
            region, node, comp = (t[c].to_numpy() for c in ("region", "node", "comp"))
            items = t["items"].to_pylist()
            edges = np.flatnonzero(np.diff(region, prepend=region[0] - 1))
            for lo, hi in zip(edges, [*edges[1:], len(node)], strict=True):
                a, b = _join_components([np.frombuffer(x, np.uint64) for x in items[lo:hi]], comp[lo:hi], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][a]), pa.array(node[lo:hi][b])], names=["a", "b"])
    return run


def _join_components(sets, comp, num, den):
    """Index pairs (a, b) of sets with den * |a & b| >= num * |a | b| that join
    the components ``comp``. Every pair of two components has an end outside
    the largest one, so only those rows are compared with all."""
    none = np.zeros(0, np.int64)
    kinds, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(which != np.argmax(count))
    if not len(outside):
        return none, none
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[token] > 1)
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(outside), len(sets)), np.float32)
    tokens = int(token[-1]) + 1 if len(token) else 0
    for first in range(0, tokens, BLOCK):
        lo, hi = np.searchsorted(token, [first, first + BLOCK])
        m = np.zeros((len(sets), min(BLOCK, tokens - first)), np.float32)
        m[owner[lo:hi], token[lo:hi] - first] = 1
        both += m[outside] @ m.T
    both = both.astype(np.int64)
    ok = den * both >= num * (size[outside][:, None] + size[None, :] - both)
    ok &= which[outside][:, None] != which[None, :]
    root = np.arange(len(kinds))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        x, y = find(which[outside[i]]), find(which[j])
        if x != y:
            root[x] = y
            keep.append((outside[i], j))
    return tuple(np.array(keep, np.int64).reshape(-1, 2).T)


def _out(a, b, kind, key=None, sk=None):
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int32()),
                                       none if key is None else pa.array([r.tobytes() for r in key], pa.binary()),
                                       none if sk is None else pa.array([r.tobytes() for r in sk], pa.binary())],
                                      names=["a", "b", "kind", "key", "sketch"])


def _edge_rows(key, sk, node):
    return _out(node, node, np.zeros(len(node), np.int32), key, sk)


_PAIRS = "a long, b long, kind int, key binary, sketch binary"


def _sets_job(k):
    def run(batches):
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text")):
                sets = _slice_sets(buf, off, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])
    return run


def _confirm_job(num, den):
    """Pairs whose sets satisfy den * intersection >= num * union."""
    def run(batches):
        for b in batches:
            xs, ys = b.column("xs").to_pylist(), b.column("ys").to_pylist()
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                m, n = len(x) // 8, len(y) // 8
                if den * min(m, n) < num * max(m, n):
                    continue
                u = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                u.sort()
                both = int((u[1:] == u[:-1]).sum())
                ok[i] = den * both >= num * (m + n - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])
    return run


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that hold on the full sets. Only documents of a pair are
    hashed again; a pair travels with its first document's set to its second
    document."""
    ends = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct(), "ends")
    sets = stage(semi_by_id(docs, ends).mapInArrow(_sets_job(k), "node long, items binary"), "sets")
    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("xs")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ys")), "b"))
    out = stage(full.select("a", "b", "xs", "ys").mapInArrow(_confirm_job(num, den), "a long, b long"), "links")
    drop_staged(docs.sparkSession, sets, ends)
    return out


def _candidates(trees: DataFrame, floor: float):
    """(pairs, documents with more than BEST partners and their regions,
    documents of the regions that were not compared whole) of the forest's
    rows (key, node, sketch)."""
    spark = trees.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    job = _neighbour_job(floor)
    found = stage(trees.select("key", "node", "sketch").repartitionByRange(n, "key", "node")
                  .sortWithinPartitions("key", "node").mapInArrow(job, _PAIRS), "pairs")
    # at most 2 * SEAM rows of each partition
    seam = stage(found.filter("kind = 0").select("key", F.col("a").alias("node"), "sketch").distinct()
                 .repartition(1).sortWithinPartitions("key", "node").mapInArrow(job, _PAIRS), "seam")
    both = found.select("a", "b", "kind").union(seam.select("a", "b", "kind"))
    pairs = stage(both.filter("kind = 1 and a <> b").select("a", "b").distinct(), "cand")
    over = stage(both.filter("kind = 2").select(F.col("b").alias("region"), F.col("a").alias("node")).distinct(), "over")
    wide = both.filter("kind > 2").select((F.col("kind") - 3).alias("tree"), F.col("b").alias("region"), F.col("a").alias("node"))
    wide = stage(wide.distinct(), "wide")
    drop_staged(spark, found, seam)
    return pairs, over, wide


def _rest(over: DataFrame, comp: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between components within the regions of ``over(region, node)``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(over.join(comp, "node", "left").select("region", "node", F.coalesce("root", "node").alias("comp")), "rows")
    open_ = (rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo <> hi").select("region"))
    rows = stage(rows.join(open_, "region", "left_semi"), "open")
    ends = stage(rows.select(F.col("node").alias("doc_id")).distinct(), "ends")
    sets = stage(semi_by_id(docs, ends).mapInArrow(_sets_job(k), "node long, items binary"), "sets")
    links = stage(rows.join(sets, "node").select("region", "node", "comp", "items").repartition(n, "region")
                  .sortWithinPartitions("region", "node").mapInArrow(_region_job(num, den), "a long, b long").distinct(), "links")
    drop_staged(spark, ends, sets)
    return links


def _whole(wide: DataFrame, comp: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``comp`` after all pairs within the regions of ``wide(tree, region,
    node)`` were compared on the full sets."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the seams' pass compared the smaller ones
    large = wide.groupBy("region").count().filter(F.col("count") > SEAM).select("region")
    large = stage(large, "large")
    if large.isEmpty():
        return comp
    wide = stage(semi_by_id(wide, large, "region"), "wide")
    for lo, hi in ((0, 1), (1, 3), (3, TREES)):
        rows = (wide.filter(F.col("tree").between(lo, hi - 1)).join(comp, "node", "left")
                .select("region", "node", F.coalesce("root", "node").alias("comp")))
        rows = stage(rows, "rows")
        # the largest component of each region, the blocks of the rows outside it and of all rows
        open_ = (rows.groupBy("region", "comp").count().groupBy("region")
                 .agg(F.max_by("comp", "count").alias("main"), F.max("count").alias("m"), F.sum("count").alias("n"))
                 .filter("m < n").select("region", "main", F.ceil((F.col("n") - F.col("m")) / REGION).alias("n_i"),
                                         F.ceil(F.col("n") / REGION).alias("n_j")))
        open_ = stage(open_, "open")
        few = open_.count()
        if not few:
            drop_staged(spark, rows, open_)
            continue
        rows = rows.join(F.broadcast(open_) if few <= BROADCAST_IDS // 4 else open_, "region")
        ends = stage(rows.select(F.col("node").alias("doc_id")).distinct(), "ends")
        sets = stage(semi_by_id(docs, ends).mapInArrow(_sets_job(k), "node long, items binary"), "sets")
        part = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(of))
        outside = rows.filter("comp <> main").select("region", "node", "comp", part(1, "n_i").alias("i"),
                                                     F.explode(F.expr("sequence(0L, n_j - 1)")).alias("j"))
        every = rows.select("region", "node", "comp", F.explode(F.expr("sequence(0L, n_i - 1)")).alias("i"),
                            part(2, "n_j").alias("j"))
        blocks = outside.unionByName(every).select(F.xxhash64("region", "i", "j").alias("region"), "node", "comp").distinct()
        links = stage(blocks.join(sets, "node").select("region", "node", "comp", "items").repartition(n, "region")
                      .sortWithinPartitions("region", "node").mapInArrow(_region_job(num, den), "a long, b long").distinct(), "links")
        drop_staged(spark, ends, sets)
        if links.count():
            comp = stage(merge_components(comp, links), "comp")
    return comp


def near_groups(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: one row per input
    row with doc_id, n_shingles, component_id and kept.

    Two documents are linked when den * |intersection| >= num * |union| of
    their shingle sets (words lower-cased A-Z). component_id is the smallest
    doc_id reachable by links. Null or wordless texts have an empty set
    (n_shingles 0), are linked with nothing and are their own component. Rows
    with a null doc_id get a null component_id, are not kept and link nothing.
    Rows that repeat a doc_id get the component of their own text. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stage(docs.mapInArrow(_signature_job(shingle),
                                "doc_id long, n_shingles long, digest binary, sig binary, sketch binary"), "sig")
    known = sig.filter("digest is not null and doc_id is not null")
    # one node for each different set: its smallest doc_id (a partial minimum,
    # so copies do not meet in one task)
    nodes = stage(known.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "sketch")).alias("m"))
                  .select(F.col("m.doc_id").alias("node"), "digest", "m.sig", "m.sketch"), "nodes")
    # a doc_id repeated with different texts could stand for several sets;
    # its sets then share one node, as they share the doc_id
    trees = stage(nodes.select("node", "sig", "sketch")
                  .mapInArrow(_tree_job, "key binary, node long, sketch binary"), "trees")
    pairs, over, wide = _candidates(trees, num / den - SKETCH_SLACK)
    drop_staged(spark, trees)
    links = _confirm(pairs, docs, shingle, num, den)
    comp = stage(components(links), "comp")
    more = _rest(over, comp, docs, shingle, num, den)
    if more.count():
        comp = stage(merge_components(comp, more), "comp")
    comp = _whole(wide, comp, docs, shingle, num, den)
    root = (nodes.select("node", "digest").join(comp, "node", "left")
            .select("digest", F.coalesce("root", "node").alias("root"), "node"))
    # repeated doc_ids: a digest keeps the smallest root found for it
    root = root.groupBy("digest").agg(F.min("root").alias("root"))
    out = (sig.select("doc_id", "n_shingles", "digest").join(root, "digest", "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
           .select("doc_id", "n_shingles", "component_id",
                   F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))
    return out
