"""Overlapping chunks by paragraphs, by pages, or by markdown sections.

Each chunker is one pure function under an Arrow UDF: their loops go as the data say, and
as a native fold over the sentences of all pages the page chunker took six times as long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.schemas import CHUNK_OVERLAP, CHUNK_SIZE

#: White space for Python's re: the same characters as functions.text.SPACE.
_SPACES = "\t\n\x0b\x0c\r\x20\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_SENTENCE = re.compile(rf"[^.!?]+[.!?]+[{_SPACES}]*|[^.!?]+\Z")
_BLANK_LINE = re.compile(rf"\n[{_SPACES}]*\n")
#: A heading line; lines end at any of these four.
_ENDS = "\n\r\u2028\u2029"
_HEADING = re.compile(rf"(?:(?<=[{_ENDS}])|\A)#{{1,6}} [^{_ENDS}]+(?=[{_ENDS}]|\Z)")
CHUNK_TYPE = "array<struct<text:string,chunk_index:int,page:int>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("chunk_index", pa.int32()), ("page", pa.int32())]))


def checked(size: int, overlap: int) -> None:
    """Options with which every step is sure to go forward."""
    if size < 1 or overlap < 0 or overlap > 0.3 * size:
        raise ValueError(f"chunk size {size} and overlap {overlap}: size must be positive and overlap within 0 and 0.3 * size")


def break_point(text: str, most: int) -> int:
    """Where to cut within the first `most` characters: after a full stop in the later half, else after a space beyond three tenths, else at the limit."""
    for mark, share in ((". ", 0.5), (" ", 0.3)):
        at = text.rfind(mark, 0, most)
        if at > share * most:
            return at + len(mark)
    return most


def paragraph_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[str]:
    """Chunks of at most `size` characters; each begins with the last `overlap` characters of the one before."""
    held = ""
    for part in filter(None, (p.strip(_SPACES) for p in _BLANK_LINE.split(text))):
        fits = len(held) + len(part) < size
        if held and not fits:
            yield held.strip(_SPACES)
            carried = held[-overlap:] if 0 < overlap < len(held) else ""
            held = f"{carried} {part}" if carried else part
        else:
            held = f"{held}\n\n{part}" if held else part
        while len(held) > size:
            at = break_point(held, size)
            yield held[:at].strip(_SPACES)
            held = held[at - overlap :].strip(_SPACES)
    if last := held.strip(_SPACES):
        yield last


def markdown_sections(text: str) -> Iterator[str]:
    """The text before the first heading, then each heading with what follows it, a blank line between."""
    cuts = [m.span() for m in _HEADING.finditer(text)]
    edges = [*[start for start, _ in cuts], len(text)]
    found = [text[: edges[0]], *[text[a:b] + "\n" + text[b:stop] for (a, b), stop in zip(cuts, edges[1:], strict=True)]]
    yield from filter(None, (s.strip(_SPACES) for s in found))


def markdown_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[str]:
    for section in markdown_sections(text):
        yield from [section] if len(section) <= size else paragraph_chunks(section, size, overlap)


def page_chunks(pages: list[str | None], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[str, int]]:
    """(chunk, page) of whole sentences across pages; a chunk has the page of its last sentence, and may exceed `size` by one long sentence."""
    held, page = "", 1
    bodies = ((n, (p or "").strip(_SPACES)) for n, p in enumerate(pages, 1))
    told = ((n, s) for n, body in bodies if body for s in _SENTENCE.findall(body) or [body])
    for n, sentence in told:
        if held and len(held) + len(sentence) >= size:
            yield held.strip(_SPACES), page
            held = held[-overlap:] if 0 < overlap < len(held) else ""
        held, page = (f"{held} {sentence}" if held else sentence), n
    if last := held.strip(_SPACES):
        yield last, page


def _udf(split, size: int, overlap: int):
    """split: a value to (text, page) pairs. Null for null."""
    checked(size, overlap)

    @F.arrow_udf(CHUNK_TYPE)
    def of(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [{"text": c, "chunk_index": i, "page": p} for i, (c, p) in enumerate(split(v, size, overlap))] for v in values.to_pylist()], _ARROW)

    return of


def _without_pages(split):
    return lambda text, size, overlap: ((c, None) for c in split(text, size, overlap))


def chunk_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    return _udf(_without_pages(paragraph_chunks), size, overlap)(text)


def chunk_markdown(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    return _udf(_without_pages(markdown_chunks), size, overlap)(text)


def chunk_pages(pages: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    return _udf(page_chunks, size, overlap)(pages)


def unnested(df: DataFrame, chunks: Column) -> DataFrame:
    """A row a chunk, with text, chunk_index and page. From inline() Spark infers a filter on the chunks, for which it makes them twice."""
    return df.select("*", F.inline_outer(chunks)).filter("chunk_index IS NOT NULL")


def chunk_route(name: Column, pages: Column) -> Column:
    """Which chunker a document takes: pages if it has any, else markdown by its (case-sensitive) suffix, else paragraphs."""
    return F.when(F.size(F.coalesce(pages, F.array().cast("array<string>"))) > 0, "pages").when(name.endswith(".md") | name.endswith(".markdown"), "markdown").otherwise("text")


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """docs (name, text, pages, ...) with `chunks`; each route is a branch of its own, so that only its rows reach its chunker."""
    routed = docs.withColumn("_route", chunk_route(F.col("name"), F.col("pages")))
    makers = {"pages": chunk_pages(F.col("pages"), size, overlap), "markdown": chunk_markdown(F.col("text"), size, overlap), "text": chunk_text(F.col("text"), size, overlap)}
    parts = [routed.filter(F.col("_route") == r).withColumn("chunks", made) for r, made in makers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_route")
