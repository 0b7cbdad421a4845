"""Files as documents: which are taken, their type, and their text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted MIME types and name endings.
PDF, DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MIMES = (PDF, DOCX, "text/plain", "text/markdown")
SUFFIXES = (".pdf", ".docx", ".txt", ".md")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def accepted(mime: Column, name: Column) -> Column:
    """By MIME type, or by the lower-cased name's ending."""
    lower = F.lower(name)
    by_name = lower.endswith(SUFFIXES[0])
    for s in SUFFIXES[1:]:
        by_name = by_name | lower.endswith(s)
    return mime.isin(*MIMES) | by_name


def document_type(mime: Column, name: Column) -> Column:
    """pdf, docx, md or txt; name endings are case-sensitive."""
    return F.when((mime == PDF) | name.endswith(".pdf"), "pdf").when((mime == DOCX) | name.endswith(".docx"), "docx").when((mime == "text/markdown") | name.endswith(".md"), "md").otherwise("txt")


def parser_route(mime: Column, name: Column) -> Column:
    """The parser that takes a file: pdf, docx or text."""
    return F.when(name.endswith(".pdf") | (mime == PDF), "pdf").when(name.endswith(".docx") | (mime == DOCX), "docx").otherwise("text")


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """id, name, mime, size, content of the accepted files under a path; ids follow from paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = raw.select(F.sha2("path", 256).alias("id"), name.alias("name"), F.lit("").alias("mime"), F.col("length").alias("size"), "content")
    return found.filter(accepted(F.col("mime"), F.col("name")))


def docx_text(content: bytes) -> str:
    """Raw text: paragraphs with a blank line after each; tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    told = lambda p: "".join(e.text or "" if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter())
    return "".join(told(p) + "\n\n" for p in root.iter(f"{_WORD}p"))


def pdf_pages(content: bytes) -> list[list[str]]:
    """Text items by page, from whichever PDF library the executors have."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF decoder on the executors; pass one to parse()") from e
    return [(p.extract_text() or "").split("\n") for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def joined_pages(pages: list[list[str | None]]) -> tuple[str, list[str]]:
    """(text, pages): items joined by a space, pages by a blank line; what is no text counts as empty."""
    told = [" ".join(i or "" for i in items) for items in pages]
    return "\n\n".join(told), told


def parse(found: DataFrame, pdf: Callable[[bytes], list[list[str]]] = pdf_pages) -> DataFrame:
    """Adds text, pages (PDF only) and error to files (mime, name, content); `content` goes. A file that can't be read has an error and null text; it never fails the job."""

    @F.arrow_udf("struct<text:string,pages:array<string>,error:string>")
    def read(routes: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("pages", pa.list_(pa.string())), ("error", pa.string())])
        for route, content in routes:
            out = []
            for r, c in zip(route.to_pylist(), content.to_pylist(), strict=True):
                try:
                    text, pages = joined_pages(pdf(c)) if r == "pdf" else (docx_text(c) if r == "docx" else (c or b"").decode("utf-8", "replace"), None)
                    out.append({"text": text, "pages": pages, "error": None})
                except Exception as e:  # noqa: BLE001 - any decoder's failure is this file's error
                    out.append({"text": None, "pages": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    return found.withColumn("_p", read(parser_route(F.col("mime"), F.col("name")), F.col("content"))).select(*[c for c in found.columns if c != "content"], "_p.text", "_p.pages", "_p.error")
