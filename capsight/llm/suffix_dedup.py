"""Exact removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
is removed. Three steps make this a distributed job and keep it exact:

1. Equal texts are one class, known by a digest: copies long enough go as a
   whole, and one of them stands for all in what follows.
2. Each window of LENGTH bytes is named by the smallest hash of its ``KMER``
   byte grams. Equal windows have equal names, so only windows whose name
   occurs twice need a look, and windows are compared within a name. Runs of
   windows of one name travel as one short piece of text.
3. Equal pieces of a name repeat whole. The different pieces of a name, those
   of many names together, form one text, cut into phrases at content-defined
   places. Its suffix array over phrases (see :func:`suffix_array`) brings
   together the places that go on alike: neighbours in suffix order whose
   phrases are equal for ``AHEAD`` bytes form a run, and within a run the
   windows around the places are compared byte by byte.

A name with more than ``HOT`` occurrences is not gathered in one task: its
windows are counted by two 64-bit hashes with partial aggregation instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm import text as tx
from capsight.llm.common import drop_staged, semi_by_id, ship, stage, whole_groups

LENGTH, KMER = 200, 32
COMPARE = 1 << 20  # bytes
HOT = 20_000
PHRASE_KMER, PHRASE_SPAN, AHEAD = 8, 32, 64
BROADCAST_ROWS = 2_000_000  # of 24 bytes: below 50 MB

_U = np.uint64


# ---------------------------------------------------------------- suffix array

def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array by grouping (linear construction after Baier, 2016).

    ``symbols`` are small non-negative integers; the last is the only 0.
    Phase 1 orders suffixes into groups by their Lyndon prefixes: groups are
    taken from the highest down, and the previous-smaller suffixes of a
    group's members move to new groups right above their own, those pointed
    at more often higher. Phase 2 emits each group's order from the pointers.
    A group is a range of ``at``; its name is the range's start, so names
    compare as groups do and nothing is renamed but what moves.
    """
    n = len(symbols)
    count = [0] * (max(symbols) + 1)
    for c in symbols:
        count[c] += 1
    begin, total = [], 0
    for c in count:
        begin.append(total)
        total += c
    size = [0] * (n + 1)
    for b, c in zip(begin, count, strict=True):
        if c:
            size[b] = c
    group = [begin[c] for c in symbols]
    fill = begin[:]
    at, where = [0] * n, [0] * n
    for i, c in enumerate(symbols):
        p = fill[c]
        fill[c] = p + 1
        at[p], where[i] = i, p
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[at[end - 1]]
        hits: dict[int, int] = {}
        # ascending order: a member met on the way left has its pointer
        for i in sorted(at[g:end]) if end - g > 1 else at[g:end]:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        end = g
        if not hits:
            continue
        if len(hits) == 1:
            levels = [list(hits)]
        else:
            by_hits: dict[int, list[int]] = {}
            for p, k in hits.items():
                by_hits.setdefault(k, []).append(p)
            levels = [by_hits[k] for k in sorted(by_hits, reverse=True)]
        for level in levels:
            for p in level:  # to the end of its group
                h = group[p]
                size[h] -= 1
                last, here = h + size[h], where[p]
                q = at[last]
                at[last], at[here] = p, q
                where[p], where[q] = last, here
            made: dict[int, int] = {}
            for p in level:
                h = group[p]
                new = h + size[h]
                group[p] = new
                made[new] = made.get(new, 0) + 1
            for new, k in made.items():
                size[new] = k
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    free = list(range(n))  # of each group, by its start: the next free place
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            p = free[g]
            free[g] = p + 1
            out[p] = j
            placed[j] = True
            j = prev[j]
    return out


# ------------------------------------------------------------- window names

def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i], ..., x[i + w - 1] for every i with a whole window."""
    k, y = 1, x
    while 2 * k <= w:
        y = op(y[:-k], y[k:])
        k *= 2
    return y if k == w else op(y[:len(x) - w + 1], y[w - k:][:len(x) - w + 1])


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    i = np.arange(len(buf) - k + 1)
    return tx.span_hash(buf, i, i + k)


def _names(buf: np.ndarray, off: np.ndarray, length: int, kmer: int):
    """(hash of every gram, name of every window, whether the window lies
    inside one document)."""
    h = _gram_hashes(buf, kmer)
    name = _slide(h, length - kmer + 1, np.minimum)
    start = np.arange(len(name))
    doc = np.searchsorted(off, start, "right") - 1
    return h, name, start + length <= off[doc + 1]


def _occurrences(buf, off, length, kmer):
    """(hash, place) of the grams that name a window."""
    if len(buf) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, name, inside = _names(buf, off, length, kmer)
    w = length - kmer + 1
    named = np.zeros(len(name) + 2 * (w - 1), np.uint64)
    named[w - 1:w - 1 + len(name)] = np.where(inside, name, _U(0))
    # gram p names a window when the largest name of the windows over it is
    # its own hash; no window over it has a larger name than that
    top = _slide(named, w, np.maximum)[:len(h)]
    at = np.flatnonzero((top == h) & (h > 0))
    return h[at], at


def _pieces(buf, off, length, kmer):
    """(name, document, first window, windows) of the runs of one name, at
    most as long as a gram can name."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none.astype(np.uint64), none, none, none
    _, name, inside = _names(buf, off, length, kmer)
    at = np.flatnonzero(inside)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    v = name[at]
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    most = length - kmer + 1
    parts = -(-n // most)
    first = np.repeat(first, parts)
    k = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    n = np.minimum(np.repeat(n, parts) - k * most, most)
    first = first + k * most
    start = at[first]
    return v[first], np.searchsorted(off, start, "right") - 1, start, n


def _name_job(length, kmer):
    """The grams that name windows, each with a hash of its place in its text;
    copies give equal places."""
    def run(batches):
        for b in batches:
            k1 = b.column("k1").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j, buf, off in tx.slices(b.column("text")):
                h, at = _occurrences(buf, off, length, kmer)
                doc = np.searchsorted(off, at, "right") - 1
                place = tx.mix(k1[i:j][doc] + (at - off[doc]).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(place.view(np.int64))],
                                                 names=["name", "place"])
    return run


def _piece_job(length, kmer):
    def run(batches):
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text")):
                v, doc, start, n = _pieces(buf, off, length, kmer)
                doc_rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(v.view(np.int64)), *(b.column(c).slice(i, j - i).take(doc_rows) for c in ("k1", "k2", "doc_id")),
                    pa.array((start - off[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["name", "k1", "k2", "doc_id", "start", "windows"])
    return run


def _read_job(length):
    """The bytes of a text's pieces."""
    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for k1, k2, text, pieces in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "pieces")), strict=True):
                raw = text.encode()
                for p in pieces:
                    out[0].append(p["name"])
                    out[1].append(k1)
                    out[2].append(k2)
                    out[3].append(p["start"])
                    out[4].append(raw[p["start"]:p["start"] + p["windows"] + length - 1])
            for s in range(0, len(out[0]), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[s:s + 4096], t) for x, t in zip(out, (pa.int64(),) * 4 + (pa.binary(),), strict=True)],
                    names=["name", "k1", "k2", "start", "piece"])
    return run


# --------------------------------------------------- repeated windows of pieces

def _cuts(buf: np.ndarray) -> np.ndarray:
    """Phrase starts: grams that are smallest in one of the PHRASE_SPAN-wide
    spans over them. Any PHRASE_SPAN neighbouring places hold one, and whether
    a place is one depends on the bytes from PHRASE_SPAN - 1 before it to
    PHRASE_SPAN + PHRASE_KMER - 2 after it."""
    w = PHRASE_SPAN
    if len(buf) < PHRASE_KMER + w - 1:
        return np.zeros(0, np.int64)
    h = _gram_hashes(buf, PHRASE_KMER)
    low = np.zeros(len(h) + w - 1, np.uint64)
    low[w - 1:len(h)] = _slide(h, w, np.minimum)
    return np.flatnonzero(_slide(low, w, np.maximum)[:len(h)] == h)


def _go_on_alike(symbols: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the phrases from ``a`` on and from ``b`` on are equal one by one
    until they hold AHEAD bytes. Where that ends depends on these phrases
    alone, so places that go on alike are neighbours in suffix order."""
    same = np.zeros(len(a), bool)
    held = np.zeros(len(a), np.int64)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[symbols[a[live] + k] == symbols[b[live] + k]]
        held[live] += width[a[live] + k]
        far = held[live] >= AHEAD
        same[live[far]] = True
        live, k = live[~far], k + 1
    return same


def _same_bytes(buf: np.ndarray, s: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """A number for each window at ``s``, equal where the windows' bytes are.
    Windows of one key are compared with the first of them, byte by byte;
    windows that follow one another in both texts share their comparisons."""
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    i = np.flatnonzero(first[which] != np.arange(len(s)))
    if not len(i):
        return which
    x, y = s[i], s[first[which[i]]]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(x) != 1) | (np.diff(y) != 1)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(i)))
    size = count + length - 1
    end = np.cumsum(size)
    wrong = []
    lo = 0
    while lo < len(start):  # about COMPARE bytes at a time
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + COMPARE, "right")))
        n, at = size[lo:hi], end[lo:hi] - size[lo:hi] - (end[lo] - size[lo])
        step = np.arange(n.sum()) - np.repeat(at, n)
        differ = buf[np.repeat(x[start[lo:hi]], n) + step] != buf[np.repeat(y[start[lo:hi]], n) + step]
        if differ.any():
            before = np.concatenate([[0], np.cumsum(differ)])
            window = np.arange(start[lo], start[hi - 1] + count[hi - 1])
            p = np.repeat(at - start[lo:hi], count[lo:hi]) + window
            wrong.append(i[window[before[p + length] > before[p]]])
        lo = hi
    if wrong:  # different windows of one key: told apart by their bytes
        names: dict[tuple, int] = {}
        most = len(first)
        for j in np.flatnonzero(np.isin(which, which[np.concatenate(wrong)])):
            which[j] = names.setdefault((which[j], buf[s[j]:s[j] + length].tobytes()), most + len(names))
    return which


def repeated_windows(pieces: list[bytes], weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the windows of the different ``pieces`` that occur
    twice or more, a piece standing for ``weight`` equal ones."""
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    off = np.concatenate([[0], np.cumsum(size)])
    cut = _cuts(buf)
    owner = np.searchsorted(off, cut, "right") - 1
    after = np.append(cut[1:], len(buf))
    ends = np.minimum(after, off[owner + 1])
    phrase = tx.span_hash(buf, cut, ends)
    _, rank = np.unique(phrase, return_inverse=True)
    # phrases of one piece after another, 1 between pieces, 0 at the end
    place = np.arange(len(cut)) + owner
    symbols = np.ones(len(cut) + len(pieces), np.int64)
    symbols[place] = rank + 2
    order = np.array(suffix_array([*symbols.tolist(), 0]))
    back = np.full(len(symbols) + 1, -1)
    back[place] = np.arange(len(cut))
    order = back[order]
    order = order[order >= 0]  # phrase starts in suffix order
    ahead = cut + AHEAD <= off[owner + 1]
    width = np.zeros(len(symbols), np.int64)
    width[place] = ends - cut
    o = order[ahead[order]]
    alike = np.zeros(len(o), np.int64)
    alike[1:] = np.cumsum(~_go_on_alike(symbols, width, place[o[:-1]], place[o[1:]]))
    run = np.full(len(cut), -1)
    run[o] = alike
    # only places that go on like another, or whose piece occurs twice
    many = np.bincount(alike, weights=weight[owner[o]], minlength=1) > 1
    good = np.flatnonzero((run >= 0) & many[np.maximum(run, 0)])
    # windows whose first phrase start at a distance of PHRASE_SPAN - 1 or
    # more is this one
    lead = PHRASE_SPAN - 1
    before = np.where((good > 0) & (owner[good - 1] == owner[good]), cut[good - 1] - lead + 1, 0)
    lo = np.maximum(np.maximum(before, off[owner[good]]), cut[good] - 2 * lead)
    hi = np.minimum(cut[good] - lead, off[owner[good] + 1] - length)
    n = np.maximum(hi - lo + 1, 0)
    s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    g = np.repeat(good, n)
    key = np.stack([run[g].astype(np.uint64), (cut[g] - s).astype(np.uint64), tx.span_hash(buf, s, s + length)])
    which = _same_bytes(buf, s, tx.mix(key[0] * _U(64) + key[1]) ^ key[2], length)
    twice = np.bincount(which, weights=weight[owner[g]], minlength=1)[which] > 1
    p = owner[g][twice]
    return p, s[twice] - off[p]


def _spans(start: np.ndarray, length: int):
    """Maximal runs covered by windows at the ascending ``start``."""
    new = np.ones(len(start), bool)
    new[1:] = np.diff(start) > length
    first = np.flatnonzero(new)
    return start[first], start[np.append(first[1:], len(start)) - 1] + length


def _group_job(length):
    def run(batches):
        for t in whole_groups(batches, "name"):
            seen: dict[tuple, int] = {}
            kinds: dict[int, int] = {}  # different pieces of each name
            pieces, of, which = [], [], np.empty(t.num_rows, np.int64)
            for i, key in enumerate(zip(t["name"].to_pylist(), t["piece"].to_pylist(), strict=True)):
                k = seen.setdefault(key, len(pieces))
                if k == len(pieces):
                    pieces.append(key[1])
                    of.append(key[0])
                    kinds[key[0]] = kinds.get(key[0], 0) + 1
                which[i] = k
            weight = np.bincount(which, minlength=len(pieces))
            found = [None] * len(pieces)
            mixed = []
            for k, name in enumerate(of):
                if weight[k] > 1:
                    found[k] = ([0], [len(pieces[k])])
                if weight[k] == 1 or kinds[name] > 1:
                    mixed.append(k)
            if mixed:
                p, s = repeated_windows([pieces[k] for k in mixed], weight[mixed], length)
                order = np.lexsort((s, p))
                p, s = p[order], s[order]
                b = tx.bounds(p, len(mixed))
                for j, k in enumerate(mixed):
                    if weight[k] == 1 and b[j + 1] > b[j]:
                        found[k] = _spans(s[b[j]:b[j + 1]], length)
            k1, k2, start = (t[c].to_numpy() for c in ("k1", "k2", "start"))
            rows = [(k1[i], k2[i], start[i] + a, start[i] + e) for i, k in enumerate(which) if found[k] is not None
                    for a, e in zip(*found[k], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 names=["k1", "k2", "lo", "hi"])
    return run


_OTHER = np.random.default_rng(17).permutation(256).astype(np.uint8)


def _window_hashes(column, length):
    """(row, window start, two hashes) of every window of a binary column."""
    rows = column.to_pylist()
    size = np.array([len(r) for r in rows])
    off = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(rows), np.uint8)
    n = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(rows)), n)
    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = off[row] + s
    return row, s, tx.span_hash(buf, a, a + length), tx.span_hash(_OTHER[buf], a, a + length)


def _hot_count_job(length):
    def run(batches):
        for b in batches:
            if b.num_rows:
                _, _, h1, h2 = _window_hashes(b.column("piece"), length)
                u, n = np.unique(np.stack([h1, h2]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u[0].view(np.int64)), pa.array(u[1].view(np.int64)),
                                                  pa.array(n.astype(np.int64))], names=["h1", "h2", "n"])
    return run


def _hot_place_job(length):
    def run(batches):
        for b in batches:
            if b.num_rows:
                row, s, h1, h2 = _window_hashes(b.column("piece"), length)
                lo = b.column("start").to_numpy()[row] + s
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                  *(pa.array(b.column(c).to_numpy()[row]) for c in ("k1", "k2")),
                                                  pa.array(lo)], names=["h1", "h2", "k1", "k2", "lo"])
    return run


# ----------------------------------------------------------------- the operator

_KEY = ["k1", "k2"]


def _few(rows: DataFrame) -> DataFrame:
    """A staged table, broadcast if it was counted to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def repeated_spans(texts: DataFrame, length: int = LENGTH, kmer: int = KMER, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans[lo, hi]): the maximal byte runs of the different texts of
    ``texts(k1, k2, doc_id, text)``, of ``length`` bytes or more each, that a
    string of ``length`` bytes starting elsewhere covers. k1, k2 digest the
    text; where a text has copies the one with the smallest doc_id is read."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = stage(texts.select("k1", "text").mapInArrow(_name_job(length, kmer), "name long, place long").groupBy("name")
                  .agg(F.min("place").alias("a"), F.max("place").alias("z"), F.count(F.lit(1)).alias("n"))
                  .filter("a <> z").select("name", "n"), "names")
    runs = texts.mapInArrow(_piece_job(length, kmer),
                            "name long, k1 long, k2 long, doc_id long, start int, windows int")
    # copies agree in all but doc_id and fall together here
    wanted = stage(semi_by_id(runs, names.select("name"), "name")
                   .groupBy("name", *_KEY, "start", "windows").agg(F.min("doc_id").alias("first"))
                   .groupBy(*_KEY).agg(F.collect_list(F.struct("name", "start", "windows")).alias("pieces"),
                                       F.min("first").alias("first")), "wanted")
    # the pieces grow with the corpus: both sides are shuffled at every size
    # the copy that is read is part of the key, so the others go elsewhere
    t, u = texts.alias("t"), wanted.hint("merge").alias("u")
    on = (F.col("t.k1") == F.col("u.k1")) & (F.col("t.k2") == F.col("u.k2")) & F.col("t.doc_id").eqNullSafe(F.col("u.first"))
    pieces = (t.join(u, on).select("t.k1", "t.k2", "t.text", "u.pieces").mapInArrow(
                  _read_job(length), "name long, k1 long, k2 long, start long, piece binary"))
    large = stage(names.filter(F.col("n") > hot).select("name"), "large")
    spans = None
    if large.count():
        pieces = stage(pieces, "pieces")
        hot_pieces = pieces.join(_few(large), "name", "left_semi")
        again = stage(hot_pieces.mapInArrow(_hot_count_job(length), "h1 long, h2 long, n long")
                      .groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2"), "again")
        spans = (hot_pieces.mapInArrow(_hot_place_job(length), "h1 long, h2 long, k1 long, k2 long, lo long")
                 .join(_few(again), ["h1", "h2"]).select(*_KEY, "lo", (F.col("lo") + length).alias("hi")))
        pieces = pieces.join(_few(large), "name", "left_anti")
    cool = (pieces.select("name", *_KEY, "start", "piece").repartition(n, "name").sortWithinPartitions("name")
            .mapInArrow(_group_job(length), "k1 long, k2 long, lo long, hi long"))
    spans = cool if spans is None else cool.union(spans)
    w = Window.partitionBy(*_KEY).orderBy("lo", "hi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    merged = stage(spans.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("long"))
                   .withColumn("run", F.sum("new").over(w)).groupBy(*_KEY, "run")
                   .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                   .groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    drop_staged(spark, names, wanted, large)
    return merged


def _cut_job(batches):
    for b in batches:
        total, gone, runs, sha = [], [], [], []
        for text, copy, spans in zip(b.column("text").to_pylist(), b.column("copy").to_pylist(),
                                     b.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            cut = [(0, len(raw))] if copy else sorted((s["lo"], s["hi"]) for s in spans or [])
            kept, at = hashlib.sha256(), 0
            for lo, hi in cut:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            total.append(len(raw))
            gone.append(sum(hi - lo for lo, hi in cut))
            runs.append(len(cut))
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (total, gone, runs)], pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_report(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed,
    n_spans and kept_sha256.

    Texts are UTF-8 bytes and are judged whole, as given; every occurrence of
    a repeated string goes, overlaps included. Every row is a document of its
    own, so rows that repeat a text remove each other. Null and short texts
    lose nothing; a null doc_id stays; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # each column's hash is the seed of the next one's, so the literal that sets k2 apart stands first
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    long = rows.filter(F.octet_length("text") >= length)
    copies = (long.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(*_KEY, F.lit(True).alias("copy")))
    spans = repeated_spans(long, length, kmer, hot)
    known = stage(copies.join(spans, _KEY, "full"), "known")
    size = known.agg(F.count(F.lit(1)) + F.sum(F.coalesce(F.size("spans"), F.lit(0)))).first()[0] or 0
    out = rows.join(F.broadcast(known) if size <= BROADCAST_ROWS else known, _KEY, "left")
    return out.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans").mapInArrow(
        _cut_job, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
