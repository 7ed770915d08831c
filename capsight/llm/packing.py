"""Hierarchical packing of documents into training sequences of several lengths.

Windows have power-of-two sizes (the tiers). Whole long windows are cut off
long documents; what is left of each document is routed to the smallest tier
that holds it. A tier's window starts with one such remainder and its gap is
filled from the shorter tiers, longest fitting remainder first, then exactly
by cutting one more remainder. Windows are therefore always full. At the end
of a partition the few remainders that found no partner are laid end to end
and cut into full windows and falling powers of two, which need no padding.

Sequences are numbered within step groups: all sequences of a group have one
length and a group holds at most ``STEP_TOKENS`` tokens, so the steps of a
training run carry equal work.

Each partition is packed on its own in one streaming pass, so there is no
shuffle; pending remainders are bounded by ``PENDING_TOKENS``.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.common import ship

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 65536
PENDING_TOKENS = 1 << 20

_ENCODERS: dict[int, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def make_encoder(spec: str):
    """Encodes a text to the ids that ``tokenizers`` gives for the JSON
    ``spec`` of a byte-level BPE whose ids are its merge ranks. The same
    vocabulary runs five times faster in tiktoken; a text that holds the
    string of an added token goes through ``tokenizers`` itself."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    data = json.loads(spec)
    letters = _byte_letters()
    added = [t["content"] for t in data.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in piece): i
             for piece, i in data["model"]["vocab"].items() if piece not in added}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_str(spec)

    def encode(text: str) -> np.ndarray:
        if any(a in text for a in added):
            ids = slow.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array([*ids, END_ID], "<u4")
    return encode


class _Packer:
    """One partition's windows. A piece is (document row, start, length)."""

    def __init__(self, part: int, tiers, step_tokens: int):
        self.tiers, self.top = tiers, tiers[-1]
        self.pending = {t: deque() for t in tiers}
        self.waiting = 0
        self.part, self.step_tokens = part, step_tokens
        self.sequences = self.steps = 0
        self.open_step: dict[int, tuple[int, int]] = {}
        self.out: list[tuple] = []

    def close(self, pieces):
        """Puts out one full window."""
        length = sum(p[2] for p in pieces)
        step, left = self.open_step.get(length, (0, 0))
        if left < length:
            step, left = self.steps, self.step_tokens
            self.steps += 1
        self.open_step[length] = (step, left - length)
        at = 0
        base = self.part << 40
        for doc, start, n in pieces:
            ids = doc[1][start:start + n]
            self.out.append((doc[0], start, n, zlib.crc32(ids.tobytes()), len(doc[1]),
                             base | self.sequences, at, length, base | step))
            at += n
        self.sequences += 1

    def add(self, doc_id, ids):
        doc, n = (doc_id, ids), len(ids)
        whole = n - n % self.top
        for s in range(0, whole, self.top):
            self.close([(doc, s, self.top)])
        if n > whole:
            self.route((doc, whole, n - whole))

    def route(self, piece):
        tier = next(t for t in self.tiers if t >= piece[2])
        if piece[2] == tier:
            self.close([piece])
            return
        self.pending[tier].append(piece)
        self.waiting += piece[2]

    def fill(self):
        """Packs every tier, longest first, while its gaps can be filled."""
        for t in reversed(self.tiers[1:]):
            queue = self.pending[t]
            while queue:
                shorter = [s for s in self.tiers if s < t]
                if sum(len(self.pending[s]) for s in shorter) < 4:
                    break
                first = queue.popleft()
                pieces, gap = [first], t - first[2]
                self.waiting -= first[2]
                for s in reversed(shorter):
                    q = self.pending[s]
                    for _ in range(min(len(q), 16)):
                        if q[0][2] <= gap:
                            pieces.append(q.popleft())
                            gap -= pieces[-1][2]
                            self.waiting -= pieces[-1][2]
                        else:
                            q.rotate(-1)
                if gap and not self.cut(pieces, gap, shorter):
                    for p in pieces:  # nothing left to cut: wait for more
                        self.pending[next(x for x in self.tiers if x >= p[2])].append(p)
                        self.waiting += p[2]
                    break
                self.close(pieces)

    def cut(self, pieces, gap, shorter):
        """Fills ``gap`` exactly from pending remainders, splitting the last."""
        for s in reversed(shorter):
            q = self.pending[s]
            while q and gap:
                doc, start, n = q.popleft()
                self.waiting -= n
                take = min(n, gap)
                pieces.append((doc, start, take))
                gap -= take
                if n > take:
                    self.route((doc, start + take, n - take))
        return not gap

    def flush(self):
        """Lays all pending remainders end to end: full windows, then falling
        powers of two."""
        rest = [p for t in reversed(self.tiers) for p in self.pending[t]]
        for q in self.pending.values():
            q.clear()
        self.waiting = 0
        total = sum(p[2] for p in rest)
        rest = deque(rest)
        while total:
            size = min(self.top, 1 << (total.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                doc, start, n = rest.popleft()
                take = min(n, gap)
                pieces.append((doc, start, take))
                if n > take:
                    rest.appendleft((doc, start + take, n - take))
                gap -= take
            self.close(pieces)
            total -= size


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, window long, step_id long")
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _pack_job(spec, tiers, step_tokens):
    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        key = spec.id if hasattr(spec, "id") else 0
        text = spec.value
        encode = _ENCODERS.get(key) or _ENCODERS.setdefault(key, make_encoder(text))
        packer = _Packer(context.partitionId() if context else 0, tiers, step_tokens)

        def rows():
            cols = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i in range(b.num_rows):
                packer.add(ids[i].as_py(), encode(texts[i].as_py() or ""))
                if packer.waiting > PENDING_TOKENS // 2:
                    packer.fill()
                if packer.waiting > PENDING_TOKENS:
                    packer.flush()
                if len(packer.out) > 20000:
                    yield rows()
        packer.fill()
        packer.flush()
        if packer.out:
            yield rows()
    return run


def pack(docs: DataFrame, path: str | None = None, tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, start (ids of the
    document before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (in its sequence), window (the sequence's length) and step_id.

    ``path`` names a tokenizers JSON of a byte-level BPE. A document is its
    ids and an end id. A null or empty text is its end id alone; rows that
    repeat a doc_id are packed each; a null doc_id stays null; other columns
    are ignored. ``tiers`` are rising powers of two.
    """
    spark = docs.sparkSession
    ship(spark)
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_pack_job(spec, tuple(tiers), step_tokens), SCHEMA))
