"""Vocabularies as bytes: what every id stands for, laid end to end."""

from __future__ import annotations

import json

import numpy as np

from capsight.llm.packing import _byte_letters


def byte_level_tokens(spec: str) -> list[bytes]:
    """The bytes of every id of a byte-level BPE in ``tokenizers`` JSON; an
    added token stands for its own text."""
    data = json.loads(spec)
    letters = _byte_letters()
    ids = {i: bytes(letters[c] for c in piece) for piece, i in data["model"]["vocab"].items()}
    ids.update((t["id"], t["content"].encode()) for t in data.get("added_tokens", []))
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


def piece_tokens(processor) -> list[bytes]:
    """The bytes of every id of a sentencepiece model: U+2581 is a space, a
    byte piece is its byte."""
    return [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(processor.id_to_piece(list(range(processor.get_piece_size()))))]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all spans (start, length), one span after the other."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(start - (end - length), length)


class TokenBytes:
    """Token bytes as one flat array with a start and a length per id."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.length[ids])]
