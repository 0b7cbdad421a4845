"""Embedding texts, behind one small interface.

An embedder is a callable from a list of texts to a float32 matrix with unit rows. The
built-in one hashes words into signed buckets (feature hashing); it is deterministic and
needs no model file. A model-backed embedder takes its place without other changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.schemas import DIMENSIONS, EMBED_BATCH

_WORD = re.compile(r"[^\W_]+")
#: FNV-1a over UTF-8, so that every process gives the same buckets.
_FNV, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


class HashingEmbedder:
    """Words, and pairs of neighbouring words at half weight, in signed buckets; rows of unit length (zero for no words)."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts) * self.dimensions)
        found = [_WORD.findall(text.lower()) for text in texts]
        words = [w for own in found for w in own]
        if words:
            row = np.repeat(np.arange(len(texts)), [len(own) for own in found])
            place: dict[str, int] = {}
            at = np.array([place.setdefault(w, len(place)) for w in words])
            known = [w.encode() for w in place]
            single = _hashes(np.full(len(known), _FNV, np.uint64), known, np.arange(len(known)))
            # A pair goes on from its first word's state, with a space and the second word.
            first, second = at[:-1], at[1:]
            near = row[:-1] == row[1:]
            first, second = first[near], second[near]
            pair = _hashes((single[first] ^ np.uint64(32)) * np.uint64(_PRIME), known, second)
            for h, rows, weight in ((single[at], row, 1.0), (pair, row[:-1][near], 0.5)):
                h = h ^ h >> np.uint64(32)
                bucket = rows * self.dimensions + ((h >> np.uint64(1)) % np.uint64(self.dimensions)).astype(np.int64)
                out += np.bincount(bucket, np.where(h & np.uint64(1), weight, -weight), len(out))
        out = out.reshape(len(texts), self.dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _hashes(states: np.ndarray, words: list[bytes], at: np.ndarray) -> np.ndarray:
    """FNV-1a states gone on through the words at `at`, before the last fold: all together byte by byte, words above 32 bytes one by one."""
    states, length = states.copy(), np.array([len(w) for w in words])
    width = min(32, int(length.max()))
    letters = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.uint64)
    prime, short = np.uint64(_PRIME), length[at] <= width
    for j in range(width):
        go = np.nonzero(short & (length[at] > j))[0]
        states[go] = (states[go] ^ letters[at[go], j]) * prime
    for i in np.nonzero(~short)[0].tolist():
        h = int(states[i])
        for byte in words[at[i]]:
            h = (h ^ byte) * _PRIME & _MASK
        states[i] = h
    return states


class Model:
    """Loads an embedder once per process; idle, loading, ready or error. Using it before it is ready is an error."""

    def __init__(self, load: Callable[[], Callable]):
        self.load, self.status, self._embed = load, "idle", None

    def start(self) -> None:
        if self.status == "ready":
            return
        self.status = "loading"
        try:
            self._embed = self.load()
        except Exception:
            self.status = "error"
            raise
        self.status = "ready"

    def __call__(self, texts: list[str], progress: Callable[[int, int], None] | None = None, batch: int = EMBED_BATCH) -> np.ndarray:
        if self._embed is None:
            raise RuntimeError("the model is not loaded")
        parts = []
        for i in range(0, len(texts), batch):
            parts.append(self._embed(texts[i : i + batch]))
            if progress:
                progress(min(i + batch, len(texts)), len(texts))
        return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


def embed(text: Column, load: Callable[[], Callable] = HashingEmbedder, batch: int = EMBED_BATCH) -> Column:
    """array<float> per text, null for null. The model is loaded once per task, on its executor."""

    @F.arrow_udf("array<float>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(load)
        model.start()
        for texts in batches:
            values = texts.to_pylist()
            found = model([t for t in values if t is not None], batch=batch)
            rows = iter(found)
            yield pa.array([None if t is None else next(rows) for t in values], pa.list_(pa.float32()))

    return of(text)
