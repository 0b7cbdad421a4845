"""The search index: a table derived from chunks, never the source of truth.

An entry is a chunk's library, ids, distinct terms with their counts, length and vector, made in
one pass over the text. Terms and counts are packed into a string each, which takes half the room
of arrays; entries, postings and stats are views of that. The packed table may be stored by
library and read back; all operations are exact by key.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.chunking import page_chunks
from vellum.session import small_batches

PACKED = "library_id string, chunk_id string, document_id string, terms string, tfs string, dl long, embedding array<float>"
COLUMNS = tuple(part.split()[0] for part in PACKED.split(", "))
#: Letters and digits: the words of functions.text.terms.
_WORD = re.compile(r"[^\W_]+")
_COUNTED = pa.struct([("terms", pa.string()), ("tfs", pa.string()), ("dl", pa.int64())])
_CUT = pa.list_(pa.struct([("chunk_index", pa.int32()), *_COUNTED]))


@dataclass(frozen=True)
class Index:
    """packed: PACKED, a row a chunk; terms, in order, and their counts are joined by a space, which no term holds, and null if there are none.

    texts, vectors: of an index that is made as it is read and joins its vectors then, the same rows but for
    the vectors, and library_id, chunk_id and embedding of rows with all vectors; for passes over one side only.
    """

    packed: DataFrame
    texts: DataFrame | None = None
    vectors: DataFrame | None = None

    @property
    def entries(self) -> DataFrame:
        """The same with arrays: terms array<string>, tfs array<int>."""
        terms, tfs = (F.coalesce(F.split(c, " ").cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("terms", "string"), ("tfs", "int")))
        return self.packed.select("library_id", "chunk_id", "document_id", terms, tfs, "dl", "embedding")

    @property
    def postings(self) -> DataFrame:
        """library_id, chunk_id, document_id, term, tf."""
        # Not by inline(): the filter that Spark infers from it makes new entries twice.
        rows = self.entries.select("library_id", "chunk_id", "document_id", F.inline_outer(F.arrays_zip("terms", "tfs"))).filter("terms IS NOT NULL")
        return rows.select("library_id", "chunk_id", "document_id", F.col("terms").alias("term"), F.col("tfs").cast("long").alias("tf"))

    @property
    def stats(self) -> DataFrame:
        """library_id, chunk_id, document_id, dl."""
        return self.packed.select("library_id", "chunk_id", "document_id", "dl")

    @staticmethod
    def empty(spark: SparkSession) -> Index:
        return Index(spark.createDataFrame([], PACKED))


def words(text: str | None) -> list[str]:
    """Search terms, in Python: see functions.text.terms."""
    return _WORD.findall(text.lower()) if text else []


def _count(text: str | None) -> dict:
    found = words(text)
    counts = Counter(found)
    own = sorted(counts)
    return {"terms": " ".join(own) if own else None, "tfs": " ".join([str(counts[t]) for t in own]) if own else None, "dl": len(found)}


def cut_and_counted(pages: Column) -> Column:
    """array of struct(chunk_index, terms, tfs, dl): the chunks of pages, counted where they are cut, so that a task takes a Python worker less and no chunk's text leaves it. Null for null."""

    @F.arrow_udf("array<struct<chunk_index:int,terms:string,tfs:string,dl:bigint>>")
    def of(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [{"chunk_index": i} | _count(c) for i, (c, _) in enumerate(page_chunks(v))] for v in values.to_pylist()], _CUT)

    return of(pages)


def counted(text: Column) -> Column:
    """struct(terms, tfs, dl) of a text, packed. As a fold over the sorted array of terms, row by row, it took several times as long."""

    @F.arrow_udf("struct<terms:string,tfs:string,dl:bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([_count(text) for text in texts.to_pylist()], _COUNTED)

    return of(text)


def build(chunks: DataFrame) -> Index:
    """The index of all libraries in chunks (id, library_id, document_id, text, and embedding if there is one). A chunk without terms has length 0 and no postings."""
    small_batches(chunks.sparkSession)
    vector = F.col("embedding") if "embedding" in chunks.columns else F.lit(None)
    base = chunks.select("library_id", F.col("id").alias("chunk_id"), "document_id", counted(F.col("text")).alias("c"), vector.cast("array<float>").alias("embedding"))
    return Index(base.select("library_id", "chunk_id", "document_id", "c.terms", "c.tfs", "c.dl", "embedding"))


def insert(index: Index, chunks: DataFrame) -> Index:
    """With the chunks' entries; chunks that are already there are replaced, not doubled."""
    ids = chunks.select("library_id", F.col("id").alias("chunk_id")).distinct()
    return Index(index.packed.join(ids, ["library_id", "chunk_id"], "left_anti").unionByName(build(chunks).packed))


def remove_library(index: Index, library_id: str) -> Index:
    return Index(index.packed.filter(F.col("library_id") != library_id))


def rebuild(index: Index, library_id: str, chunks: DataFrame) -> Index:
    """The library's entries made anew; without chunks it has no index afterwards."""
    new = build(chunks.filter(F.col("library_id") == library_id))
    return Index(remove_library(index, library_id).packed.unionByName(new.packed))


def remove_documents(index: Index, ids: DataFrame) -> Index:
    """Without the documents in ids (id), however many chunks they have."""
    gone = ids.select(F.col("id").alias("document_id")).distinct()
    return Index(index.packed.join(gone, "document_id", "left_anti"))


def exists(index: Index, library_id: str) -> bool:
    return not index.stats.filter(F.col("library_id") == library_id).isEmpty()


def hydrate(index: Index, library_id: str, chunks: DataFrame) -> Index:
    """Built from the chunks if the library has no index yet."""
    return index if exists(index, library_id) else rebuild(index, library_id, chunks)


def save(index: Index, path: str) -> None:
    """Stored by library; only the libraries in the index are overwritten. The folder's name is marked, so that an empty name isn't read back as null."""
    parts = index.packed.withColumn("part", F.concat(F.lit("in "), "library_id"))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(f"{path}/entries")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.schema(PACKED).parquet(f"{path}/entries").select(*COLUMNS))


def library_stats(index: Index) -> DataFrame:
    """library_id, n, avgdl."""
    return index.stats.groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(index: Index) -> DataFrame:
    return index.postings.groupBy("library_id", "term").agg(F.count(F.lit(1)).alias("df"))
