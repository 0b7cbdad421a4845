"""The catalog: libraries, documents, contents and chunks as one immutable snapshot.

A change is a function from a snapshot to a new one. Counts of documents and chunks are
always recomputed from the rows they count, and deletions cascade as anti-joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.schemas import INTERRUPTED, PROCESSING, TABLES

# What a viewer shows where there is no content.
FAILED, PENDING = "Document processing failed", "Document is being processed..."


@dataclass(frozen=True)
class Snapshot:
    """libraries, documents, contents, chunks: the whole state at one version."""

    libraries: DataFrame
    documents: DataFrame
    contents: DataFrame
    chunks: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Snapshot:
        return Snapshot(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})

    @property
    def spark(self) -> SparkSession:
        return self.libraries.sparkSession


# Reads: every one is a filter that reaches the scan, or a total order that ends in the id.


def get(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.filter(F.col(key) == value)


def where(table: DataFrame, **equal: object) -> DataFrame:
    """Conjunction of equalities; a list is a choice of values."""
    for key, value in equal.items():
        table = table.filter(F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
    return table


def newest_first(table: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return table.orderBy(F.desc(created), key)


def newest_places(table: DataFrame, by: str = "library_id", created: str = "created_at", key: str = "id") -> DataFrame:
    """With `place` (from 1) of each row in the newest-first order of its group.

    Two-level: a group is cut into about the square root of its rows many spans of `created`,
    ranks are taken within spans and the totals of newer spans added, so a hot group is spread.
    """
    groups = table.groupBy(F.col(by).alias("_by")).agg(F.max(created).alias("_most"), F.ceil((F.max(created) - F.min(created) + 1) / F.ceil(F.sqrt(F.count(F.lit(1))))).alias("_width"))
    span = F.floor((F.col("_most") - F.col(created)) / F.col("_width"))
    placed = table.join(F.broadcast(groups), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_span", span).drop("_by", "_most", "_width")
    totals = placed.groupBy(F.col(by).alias("_by"), F.col("_span").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy("_by").orderBy(F.col("_of")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).drop("_n")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_span").orderBy(F.desc(created), key)))
    out = ranked.join(totals, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_of")))
    return out.withColumn("place", F.col("_rank") + F.col("_before")).select(*table.columns, "place")


def first_match(table: DataFrame, *order: str) -> DataFrame:
    return table.orderBy(*order).limit(1)


# Writes.


def insert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is new; of new rows with one key, any one."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The given rows take the place of those with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def patch(table: DataFrame, changes: DataFrame, key: str, clears: tuple[str, ...] = ()) -> DataFrame:
    """Columns of `changes` (key, some columns; one row a key) replace those of the table where not null; columns in `clears` become null in every changed row."""
    named = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key], F.lit(True).alias("_hit"))
    joined = table.join(named, key, "left")
    out = [
        F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in clears else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c)
        for c in table.columns
    ]
    return joined.select(*out)


def without(table: DataFrame, ids: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """Rows whose `key` is not among the ids."""
    return table.join(ids.select(F.col(id_).alias(key)).distinct(), key, "left_anti").select(*table.columns)


def recount(s: Snapshot) -> Snapshot:
    """All stored counts, recomputed."""
    chunks = s.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_chunks"))
    documents = s.documents.join(chunks, s.documents["id"] == chunks["document_id"], "left")
    documents = documents.withColumn("chunk_count", F.coalesce("_chunks", F.lit(0))).select(*s.documents.columns)
    per = library_counters(s.libraries, documents)
    libraries = s.libraries.drop("document_count", "chunk_count").join(per, s.libraries["id"] == per["library_id"]).select(*s.libraries.columns)
    return replace(s, documents=documents, libraries=libraries)


def library_counters(libraries: DataFrame, documents: DataFrame) -> DataFrame:
    """library_id, document_count, chunk_count of every library, also of those without documents."""
    per = documents.groupBy("library_id").agg(F.count(F.lit(1)).alias("d"), F.sum("chunk_count").alias("c"))
    return libraries.select(F.col("id").alias("library_id")).join(per, "library_id", "left").select("library_id", F.coalesce("d", F.lit(0)).alias("document_count"), F.coalesce("c", F.lit(0)).alias("chunk_count"))


def create_library(s: Snapshot, library_id: str, name: str, now: int, description: str | None = None) -> Snapshot:
    row = s.spark.createDataFrame([(library_id, name.strip(), description, now, now, 0, 0)], TABLES["libraries"])
    return replace(s, libraries=insert(s.libraries, row))


def update_library(s: Snapshot, library_id: str, now: int, name: str | None = None, description: str | None = None) -> Snapshot:
    changes = s.spark.createDataFrame([(library_id, name, description, now)], "id string, name string, description string, updated_at long")
    return replace(s, libraries=patch(s.libraries, changes, "id"))


def create_documents(s: Snapshot, files: DataFrame, library_id: str | None, now: int) -> Snapshot:
    """files: id, name, type, size, and library_id where none is given. New documents are pending; the library need not exist."""
    library = F.col("library_id") if library_id is None else F.lit(library_id).alias("library_id")
    rows = files.select("id", library, "name", "type", F.col("size").cast("long").alias("size"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("chunk_count"), F.lit(None).cast("int").alias("processing_progress"), F.lit(None).cast("string").alias("error"))
    return recount(replace(s, documents=insert(s.documents, rows)))


def set_status(s: Snapshot, changes: DataFrame, now: int) -> Snapshot:
    """changes: id, status, and optionally processing_progress. Progress is cleared where the new status ends the work."""
    done = changes.filter(F.col("status").isin("indexed", "error")).select("id", "status")
    open_ = changes.filter(~F.col("status").isin("indexed", "error"))
    stamp = lambda d: d.withColumn("updated_at", F.lit(now).cast("long"))
    documents = patch(patch(s.documents, stamp(open_), "id"), stamp(done), "id", ("processing_progress",))
    return replace(s, documents=documents)


def save_contents(s: Snapshot, rows: DataFrame) -> Snapshot:
    return replace(s, contents=upsert(s.contents, rows, "document_id"))


def delete_documents(s: Snapshot, ids: DataFrame) -> Snapshot:
    """ids: id. Documents with their contents and chunks; unknown ids change nothing."""
    return recount(replace(s, documents=without(s.documents, ids, "id"), contents=without(s.contents, ids, "document_id"), chunks=without(s.chunks, ids, "document_id")))


def delete_library(s: Snapshot, library_id: str) -> Snapshot:
    """With all that belongs to it."""
    rest = {name: getattr(s, name).filter(F.col("id" if name == "libraries" else "library_id") != library_id) for name in TABLES}
    return Snapshot(**rest)


def interrupted(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isin(*INTERRUPTED))


def cleanup_interrupted(s: Snapshot) -> Snapshot:
    return delete_documents(s, interrupted(s.documents).select("id"))


# Counts, flags and joins that views show.


def is_processing(status: Column) -> Column:
    return status.isin(*PROCESSING)


def status_counts(documents: DataFrame, libraries: DataFrame) -> DataFrame:
    """library_id, indexed, processing, any_processing of every library (id), also of those without documents."""
    per = documents.groupBy("library_id").agg(F.count_if(F.col("status") == "indexed").alias("_indexed"), F.count_if(is_processing(F.col("status"))).alias("_processing"))
    indexed, processing = F.coalesce("_indexed", F.lit(0)), F.coalesce("_processing", F.lit(0))
    return libraries.select(F.col("id").alias("library_id")).join(per, "library_id", "left").select("library_id", indexed.alias("indexed"), processing.alias("processing"), (processing > 0).alias("any_processing"))


def landing_route(indexed: Column) -> Column:
    return F.when(indexed > 0, "search").otherwise("documents")


def flags(status: Column) -> dict[str, Column]:
    return {"viewable": status == "indexed", "processing": is_processing(status), "failed": status == "error", "progress_bar": ~status.isin("indexed", "error")}


def with_content(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """documents with text and pages (null where there is no content), and what a viewer shows: the text, else a notice."""
    c = contents.select(F.col("document_id").alias("_doc"), F.col("text").alias("content"), F.col("pages").alias("content_pages"))
    joined = documents.join(c, documents["id"] == c["_doc"], "left").drop("_doc")
    shown = F.coalesce("content", F.when(F.col("status") == "error", FAILED).otherwise(PENDING))
    return joined.withColumn("shown", shown)


def libraries_with_documents(libraries: DataFrame, documents: DataFrame) -> DataFrame:
    """library_id, name, documents: the library's documents (id, name, created_at), newest first; empty for none."""
    item = F.struct((-F.col("created_at")).alias("k"), F.col("id").alias("id"), F.col("name").alias("name"), F.col("created_at").alias("created_at"))
    nested = documents.groupBy("library_id").agg(F.sort_array(F.collect_list(item)).alias("docs"))
    nested = nested.withColumn("docs", F.transform("docs", lambda d: F.struct(d.id.alias("id"), d["name"].alias("name"), d.created_at.alias("created_at"))))
    return libraries.select(F.col("id").alias("library_id"), "name").join(nested, "library_id", "left").withColumnRenamed("docs", "documents")
