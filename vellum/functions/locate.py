"""Where a chunk lies in its document's text."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import around
from vellum.operators.chunking import _SPACES

_GAPS = re.compile(f"[{_SPACES}]+")
_SOLID = re.compile(f"[^{_SPACES}]+")
_RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.bool_())]))
# Characters skipped (the overlap may not be in the text as it stands), and the least that must remain.
SKIPS, LEAST_CORE = (150, 100, 60), 20


class Places:
    """A text, in which chunks are found. Its form without white space is made once for all of them."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def bare(self) -> str:
        return _GAPS.sub("", self.text)

    @cached_property
    def places(self) -> np.ndarray:
        """Where the characters of bare stand in the text."""
        spans = [m.span() for m in _SOLID.finditer(self.text)]
        return np.concatenate([np.arange(*s) for s in spans]) if spans else np.zeros(0, np.int64)

    def of(self, chunk: str) -> tuple[int, int] | None:
        """(start, end) of the chunk: as it stands, else regardless of white space, else by what follows a skipped beginning."""
        at = self.text.find(chunk)
        if at >= 0:
            return at, at + len(chunk)
        core = _GAPS.sub("", chunk)
        for skip in (0, *[s for s in SKIPS if s < len(core) - LEAST_CORE]):
            at = self.bare.find(core[skip:])
            if at < 0:
                continue
            if not self.bare:
                return None
            last = at + len(core) - skip - 1
            return int(self.places[max(0, at - skip)]), int(self.places[last]) + 1 if last >= 0 else int(self.places[0])
        return None


def locate(text: str, chunk: str) -> tuple[int, int] | None:
    """See Places.of()."""
    return Places(text).of(chunk)


def find_chunk(text: Column, chunk: Column) -> Column:
    """struct(start, end), half-open, or null."""

    @F.arrow_udf("struct<start:int,end:int>")
    def find(texts: pa.Array, chunks: pa.Array) -> pa.Array:
        found = [None if t is None or c is None else locate(t, c) for t, c in zip(texts.to_pylist(), chunks.to_pylist(), strict=True)]
        return pa.array([f and {"start": f[0], "end": f[1]} for f in found], _RANGE)

    return find(text, chunk)


def find_chunks(text: Column, chunks: Column) -> Column:
    """array<struct(start, end, found)> of a document's chunks, in their order: where each lies, and whether before, match and after there make up the text."""

    def placed(text: str, chunks: list[str]) -> list[dict]:
        held, out = Places(text), []
        for chunk in chunks:
            at = held.of(chunk)
            if at is None:
                out.append({"start": None, "end": None, "found": False})
            else:
                a, b = at
                out.append({"start": a, "end": b, "found": text[:a] + text[a:b] + text[b:] == text})
        return out

    @F.arrow_udf("array<struct<start:int,end:int,found:boolean>>")
    def find(texts: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([None if t is None or c is None else placed(t, c) for t, c in zip(texts.to_pylist(), parts.to_pylist(), strict=True)], _FOUND)

    return find(text, chunks)


def highlight(text: Column, found: Column) -> list[Column]:
    """before, match, after; all the text is `before` where nothing was found."""
    start, end = found.getField("start"), found.getField("end")
    parts = around(text, start, end)
    return [F.coalesce(parts[0], text), F.coalesce(parts[1], F.lit("")), F.coalesce(parts[2], F.lit(""))]
