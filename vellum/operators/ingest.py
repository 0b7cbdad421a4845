"""Ingestion: files to searchable chunks, in one narrow plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.numbers import chunk_id
from vellum.operators.catalog import Snapshot, create_documents, patch, recount, save_contents, upsert
from vellum.operators.chunking import chunk_documents, unnested
from vellum.operators.embedding import HashingEmbedder, embed
from vellum.schemas import CHUNK_OVERLAP, CHUNK_SIZE, NO_TEXT
from vellum.session import small_batches, stored
from vellum.sources.files import document_type


def cut_rows(parsed: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunk table of parsed documents (id, library_id, name, text, pages) but for its embeddings: chunked and unnested without a shuffle."""
    small_batches(parsed.sparkSession)
    docs = parsed.filter("text IS NOT NULL").select(F.col("id").alias("document_id"), "library_id", "name", "text", "pages")
    cut = chunk_documents(docs, size, overlap).select("library_id", "document_id", F.col("name").alias("document_name"), "chunks")
    rows = unnested(cut, F.col("chunks"))
    return rows.select(chunk_id(F.col("library_id"), F.col("document_id"), F.col("chunk_index")).alias("id"), "library_id", "document_id", "document_name", "chunk_index", "text", "page")


def embedded(rows: DataFrame, load: Callable = HashingEmbedder) -> DataFrame:
    """The chunk table of cut_rows(), with embeddings."""
    small_batches(rows.sparkSession)
    return rows.select("id", "library_id", "document_id", "document_name", "chunk_index", "text", embed(F.col("text"), load).alias("embedding"), "page")


def chunk_rows(parsed: DataFrame, load: Callable = HashingEmbedder, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The whole chunk table of parsed documents, in one narrow stage."""
    return embedded(cut_rows(parsed, size, overlap), load)


def outcome(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, status, error of each document: indexed, or error if it could not be read or gave no chunk."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n").isNull(), F.lit(NO_TEXT))
    return parsed.select("id", "error").join(n, "id", "left").select("id", F.when(error.isNull(), "indexed").otherwise("error").alias("status"), error.alias("error"))


def ingest(s: Snapshot, parsed: DataFrame, library_id: str | None, now: int, load: Callable = HashingEmbedder) -> Snapshot:
    """A snapshot with the parsed files (id, name, mime, size, text, pages, error) ingested into a library; with None, each into the library that its own column library_id names.

    Ids follow from the files, so a repeated run replaces its own rows: a document left
    half done by a lost run is simply done again.
    """
    placed = parsed if library_id is None else parsed.withColumn("library_id", F.lit(library_id))
    # Counts, states and contents read the chunks as well: they are cut once, and stored without their vectors.
    rows = stored(cut_rows(placed), "cut")
    chunks = embedded(rows, load)
    files = placed.select("id", "library_id", "name", document_type(F.col("mime"), F.col("name")).alias("type"), "size")
    s = create_documents(s, files, library_id, now)
    documents = patch(s.documents, outcome(placed, rows).withColumn("updated_at", F.lit(now).cast("long")), "id", ("processing_progress",))
    s = save_contents(replace(s, documents=documents), placed.filter("text IS NOT NULL").select(F.col("id").alias("document_id"), "library_id", "text", "pages"))
    rest = s.chunks.join(placed.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").select(*s.chunks.columns)
    return recount(replace(s, chunks=upsert(rest, chunks.select(*s.chunks.columns), "id")))
