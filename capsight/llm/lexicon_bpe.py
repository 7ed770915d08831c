"""Byte-level BPE encoding and decoding by an automaton of frequent words.

Text is cut into words (the tokenizer's pre-tokens) with array operations over
code points. The corpus's most frequent words are compiled, with the ids that
the merges give them, into a minimal acyclic transducer: states with the same
continuations are shared, and the numbers on a path add up to the word's row
in a table of id lists. The automaton lies in one file that Spark sends to the
executors and that their Python workers map into memory, so all workers of a
machine share one copy. Words the automaton does not accept are merged exactly,
lowest merge first. Which words are in it decides speed alone, not the ids.

Decoding joins the ids' bytes and reads them as UTF-8, bad bytes as U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.llm.common import drop_staged, ship, stage
from capsight.llm.packing import _byte_letters
from capsight.llm.text import slices, span_hash
from capsight.llm.vocab import TokenBytes, byte_level_tokens, spread
from capsight.session import ensure_checkpoint_dir

WORDS = 1 << 18       # words in the automaton
LONGEST = 40          # bytes of its longest word
_PENDING = 200_000    # distinct words a counting task holds
_REMEMBERED = 200_000  # merged words a task remembers

_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _UNKNOWN = 1, 2, 3, 4, 5, 255
_CACHE: dict = {}


class WordCutter:
    """Cuts texts into the words of the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    The class of a code point is asked of the tokenizer itself, once."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel
        self.ask = ByteLevel(add_prefix_space=False)
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.kind[32] = _BLANK

    def learn(self, points: np.ndarray) -> None:
        for p in np.unique(points).tolist():
            def parts(after, c=chr(p)):
                return [x[1] for x in self.ask.pre_tokenize_str(f"a{c}{after}")]
            if (0, 2) in (one := parts("1")) or (0, 3) in one:
                self.kind[p] = _LETTER
            elif (1, 3) in one:
                self.kind[p] = _NUMBER
            else:
                self.kind[p] = _OTHER if (1, 3) in parts("!") else _WHITE

    def cut(self, buf: np.ndarray, off: np.ndarray, apart=()) -> np.ndarray:
        """First bytes of all words of the texts ``buf[off[i]:off[i + 1]]``.
        ``apart`` holds (start, end) byte spans that are words of their own."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[points]
        if (new := kind == _UNKNOWN).any():
            self.learn(points[new])
            kind = self.kind[points]
        fresh = np.zeros(n + 1, bool)  # a text or a part of one starts here
        fresh[np.searchsorted(lead, off)] = True
        for s, e in apart:
            fresh[np.searchsorted(lead, [s, e])] = True
        white = kind >= _BLANK
        group = np.minimum(kind, _BLANK)
        start = fresh[:n].copy()
        start[1:] |= group[1:] != group[:-1]
        # the last blank of a run goes with what follows, another white space stands alone
        follows = np.zeros(n, bool)
        follows[1:] = white[:-1] & ~white[1:] & ~fresh[1:n]
        at = np.flatnonzero(follows)
        start[at - 1] = True
        start[at] = points[at - 1] != 32
        # 's 't 'm 'd 're 've 'll where a word starts with the apostrophe
        quote = np.flatnonzero((points == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[~fresh[quote + 1]]
        one = points[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        long = quote[quote + 2 < n]
        long = long[~fresh[long + 2]]
        pair = points[long + 1].astype(np.int64) * 256 + np.minimum(points[long + 2], 255)
        long = long[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]
        for where, size in ((short, 2), (long, 3)):
            start[where + 1] = False
            end = where + size
            start[end[end < n]] = True
        for s, e in apart:
            i, j = np.searchsorted(lead, [s, e])
            start[i + 1:j] = False
        return lead[start]


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct ``words``, built in one
    pass with a register of finished states. Arcs are sorted by (state, byte);
    the ``add`` of the arcs on a word's path sum to its place in ``words``."""
    register: dict = {}
    states: list[tuple] = []  # (final, ((byte, state), ...), words from here)

    def finish(node):
        arcs = tuple(node[1])
        key = (node[0], arcs)
        if key not in register:
            register[key] = len(states)
            states.append((node[0], arcs, node[0] + sum(states[t][2] for _, t in arcs)))
        return register[key]

    path = [[False, []]]  # the open states of the word before
    last = b""
    for w in [*words, None]:
        keep = 0
        if w is not None:
            top = min(len(w), len(last))
            while keep < top and w[keep] == last[keep]:
                keep += 1
        while len(path) > keep + 1:
            done = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        if w is not None:
            path += [[False, []] for _ in range(len(w) - keep)]
            path[-1][0] = True
            last = w
    root = finish(path[0])
    key, to, add = [], [], []
    for s, (final, arcs, _) in enumerate(states):
        before = int(final)
        for byte, t in arcs:
            key.append(s << 8 | byte)
            to.append(t)
            add.append(before)
            before += states[t][2]
    return {"key": np.array(key, np.int64), "to": np.array(to, np.int64), "add": np.array(add, np.int64),
            "final": np.array([s[0] for s in states], np.int64), "root": np.array([root], np.int64)}


def walk(auto: dict, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number of each word, -1 for words that the automaton does not accept."""
    number = np.full(len(start), -1, np.int64)
    longest = int(auto["longest"][0])
    live = np.flatnonzero((length > 0) & (length <= longest))
    state, total = np.full(len(live), auto["root"][0]), np.zeros(len(live), np.int64)
    key, final = auto["key"], auto["final"]
    for p in range(longest if len(key) else 0):
        want = state << 8 | buf[start[live] + p]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = key[at] == want
        live, at = live[ok], at[ok]
        state, total = auto["to"][at], total[ok] + auto["add"][at]
        over = length[live] == p + 1
        done = over & (final[state] == 1)
        number[live[done]] = total[done]
        live, state, total = live[~over], state[~over], total[~over]
        if not len(live):
            break
    return number


class Merger:
    """Exact byte-level BPE of one word: the lowest merge first, the leftmost
    of equals. A usual word is merged in a list; a long one with a heap, so
    that a word of any length costs n log n."""

    none = 1 << 60

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab, letters = data["model"]["vocab"], _byte_letters()
        self.byte = [0] * 256
        for c, b in letters.items():
            self.byte[b] = vocab[c]
        self.merges = {}
        for rank, m in enumerate(data["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[x], vocab[y]), (rank, vocab[x + y]))
        self.packed = {pair: rank << 32 | new for pair, (rank, new) in self.merges.items()}

    def ids(self, word: bytes) -> list[int]:
        ids = [self.byte[b] for b in word]
        if len(ids) > 100:
            return self.long(ids)
        merges, none = self.packed, self.none
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (low := min(pairs)) != none:
            i, new = pairs.index(low), low & 0xFFFFFFFF
            ids[i:i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], new), none)
            if i < len(pairs):
                pairs[i] = merges.get((new, ids[i + 1]), none)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class Codec:
    """Encodes and decodes with an automaton mapped from ``path``."""

    def __init__(self, spec: str, path: str):
        check_spec(spec)
        self.cutter, self.merger = WordCutter(), Merger(spec)
        self.special = [(t["content"].encode(), t["id"]) for t in json.loads(spec).get("added_tokens", [])]
        self.tokens = TokenBytes(byte_level_tokens(spec))
        self.auto = open_automaton(path)
        self.written = [str(i) for i in range(len(self.tokens.length))]
        self.merged: dict[bytes, list[int]] = {}

    def apart(self, data: bytes, off) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens' strings, each within a text:
        the leftmost first, of several there the first listed."""
        found = []
        if not any(s in data for s, _ in self.special):
            return found
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            while True:
                hits = [(p, k) for k, (s, _) in enumerate(self.special) if (p := data.find(s, a, b)) >= 0]
                if not hits:
                    break
                p, k = min(hits)
                a = p + len(self.special[k][0])
                found.append((p, a, self.special[k][1]))
        return found

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """(ids of all texts, end of each text's ids)."""
        data = buf.tobytes()
        apart = self.apart(data, off)
        start = self.cutter.cut(buf, off, [x[:2] for x in apart])
        length = np.diff(np.append(start, len(buf)))
        number = walk(self.auto, buf, start, length)
        row, size = self.auto["row"], self.auto["size"]
        known = number >= 0
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[known], count[known] = row[number[known]], size[number[known]]
        extra: list[int] = []
        base = len(self.auto["ids"])
        places: dict[bytes, tuple[int, int]] = {}
        special = {s: i for s, _, i in apart}
        for w in np.flatnonzero(~known | np.isin(start, list(special))).tolist():
            s = int(start[w])
            word = data[s:s + int(length[w])]
            if s in special:
                ids = [special[s]]
                first[w], count[w] = base + len(extra), 1
                extra += ids
                continue
            if word not in places:
                if (ids := self.merged.get(word)) is None:
                    if len(self.merged) >= _REMEMBERED:
                        self.merged.clear()
                    ids = self.merged[word] = self.merger.ids(word)
                places[word] = base + len(extra), len(ids)
                extra += ids
            first[w], count[w] = places[word]
        table = np.concatenate([self.auto["ids"], np.array(extra, np.int64)]) if extra else self.auto["ids"]
        ids = table[spread(first, count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.join(ids).tobytes().decode("utf-8", "replace")


def check_spec(spec: str) -> None:
    """Raises for a tokenizer with features that this module does not have."""
    d = json.loads(spec)
    m, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = all(not t[k] for t in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if (m.get("type", "BPE") != "BPE" or m.get("dropout") or m.get("byte_fallback") or m.get("ignore_merges")
            or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix") or d.get("normalizer")
            or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or not plain):
        raise ValueError("only a plain byte-level BPE without normalizer is supported")


_PARTS = ("key", "to", "add", "final", "root", "longest", "row", "size", "ids")


def compile_lexicon(spec: str, words: list[bytes]) -> bytes:
    """The automaton and the words' ids as one block of 64-bit numbers: nine
    lengths, then the nine arrays of ``_PARTS``."""
    words = sorted(set(words))
    auto = build_automaton(words)
    merger = Merger(spec)
    ids = [merger.ids(w) for w in words]
    auto["longest"] = np.array([max(map(len, words), default=0)], np.int64)
    auto["size"] = np.array([len(x) for x in ids], np.int64)
    auto["row"] = np.cumsum(auto["size"]) - auto["size"]
    auto["ids"] = np.array([i for x in ids for i in x], np.int64)
    return b"".join(x.astype("<i8").tobytes() for x in
                    [np.array([len(auto[p]) for p in _PARTS]), *(auto[p] for p in _PARTS)])


def open_automaton(path: str) -> dict[str, np.ndarray]:
    """The arrays of a compiled lexicon, mapped from its file."""
    flat = np.memmap(path, "<i8", "r")
    cut = np.concatenate([[0], np.cumsum(flat[:len(_PARTS)])]) + len(_PARTS)
    return {p: flat[a:b] for p, a, b in zip(_PARTS, cut[:-1], cut[1:], strict=True)}


def _count_job(longest):
    def run(batches):
        cutter = _CACHE.setdefault("cutter", WordCutter())
        held: dict[bytes, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                start = cutter.cut(buf, off)
                length = np.diff(np.append(start, len(buf)))
                short = length <= longest
                start, length = start[short], length[short]
                # equal hashes are counted as one word: a clash costs speed, not ids
                _, one, n = np.unique(span_hash(buf, start, start + length), return_index=True, return_counts=True)
                data = buf.tobytes()
                for s, size, c in zip(start[one].tolist(), length[one].tolist(), n.tolist(), strict=True):
                    w = data[s:s + size]
                    held[w] = held.get(w, 0) + c
                if len(held) > _PENDING:
                    yield rows()
        yield rows()
    return run


def frequent_words(docs: DataFrame, words: int = WORDS, longest: int = LONGEST) -> list[bytes]:
    """The most frequent words of up to ``longest`` bytes of all texts, counted
    in the tasks first: as many whole classes of like counts (steps of an eighth
    of a power of two) as ``words`` holds, so that no task sorts them all."""
    counts = (docs.select("text").mapInArrow(_count_job(longest), "word binary, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    counts = stage(counts.withColumn("class", F.floor(F.log2("n") * 8)), "words")
    held, least = 0, None
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        held += r["count"]
        if held > words:
            break
        least = r["class"]
    found = [] if least is None else counts.filter(F.col("class") >= least).select("word").toArrow()["word"].to_pylist()
    drop_staged(docs.sparkSession, counts)
    return found


def send_lexicon(spark: SparkSession, data: bytes) -> str:
    """Writes the compiled lexicon to the shared checkpoint folder and has Spark
    hand it to every executor; returns the name to ask for."""
    name = f"capsight-lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def _codec(name: str, spec) -> Codec:
    if name not in _CACHE:
        from pyspark import SparkFiles
        _CACHE.clear()
        _CACHE[name] = Codec(spec.value, SparkFiles.get(name))
    return _CACHE[name]


def _encode_job(name, spec):
    def run(batches):
        codec = _codec(name, spec)
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text")):
                ids, cut = codec.encode(buf, off)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"])
    return run


def _report_job(name, spec):
    def run(batches):
        codec = _codec(name, spec)
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text")):
                ids, cut = codec.encode(buf, off)
                written = [codec.written[x] for x in ids.tolist()]
                raw = codec.tokens.join(ids).tobytes()
                upto = np.concatenate([[0], np.cumsum(codec.tokens.length[ids])])[cut]
                hashes = [[], []]
                for a, b, x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    hashes[0].append(hashlib.sha256(",".join(written[a:b]).encode()).hexdigest())
                    hashes[1].append(hashlib.sha256(raw[x:y].decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(np.diff(cut)), pa.array(hashes[0]), pa.array(hashes[1])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _decode_job(name, spec):
    def run(batches):
        codec = _codec(name, spec)
        for b in batches:
            ids = b.column("ids")
            flat = ids.flatten().to_numpy().astype(np.int64)
            size = ids.value_lengths().fill_null(0).to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])
            texts = [codec.decode(flat[a:e]) for a, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def prepare(docs: DataFrame, path: str | None = None, words: int = WORDS):
    """(name of the lexicon on the executors, the tokenizer's JSON as broadcast):
    counts the words of ``docs``, compiles the automaton and sends it."""
    spark = docs.sparkSession
    ship(spark)
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    check_spec(spec)
    name = send_lexicon(spark, compile_lexicon(spec, frequent_words(docs, words)))
    return name, spark.sparkContext.broadcast(spec)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, lexicon) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``, as the tokenizer's
    own encode without special tokens gives them; ``lexicon`` comes from
    :func:`prepare`. A null or empty text has no ids."""
    return _texts(docs).mapInArrow(_encode_job(*lexicon), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, lexicon) -> DataFrame:
    """(doc_id, text) of every row of ``encoded(doc_id, ids)``; special tokens'
    strings included, null ids as none."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        _decode_job(*lexicon), "doc_id long, text string")


def report(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of the text that the ids decode to).

    A null or empty text has no ids. Rows that repeat a doc_id are rows of
    their own, a null doc_id stays null, other columns are ignored; an empty
    table gives no rows.
    """
    docs = _texts(docs)
    return docs.mapInArrow(_report_job(*prepare(docs, path, words)),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
