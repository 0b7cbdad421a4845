"""The corpus pipeline: quality, exact and near deduplication, source mix, packing.

STAGES are applied in order; each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import lower_ascii, release, stored
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.mixing import mix_sources
from vellum.llm.near_dedup import near_kept, text_hash
from vellum.llm.packing import pack
from vellum.llm.quality import quality_filter
from vellum.llm.tokens import TOKENIZER


def _whole(docs: DataFrame, **keys: Column) -> DataFrame:
    """`row`, a struct of all columns, and keys: no name of an input column can clash with a key."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("row"), *[key.alias(name) for name, key in keys.items()])


def _chosen(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows (row, and `on`) whose keys are among keys (on, n); of the n rows of one key, one."""
    named = keys.select(*[F.col(k).alias(f"of_{k}") for k in on], "n")
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    met = rows.join(named.hint("shuffle_hash"), same)
    return met.filter("n = 1").select("row.*").unionByName(met.filter("n > 1").dropDuplicates(on).select("row.*"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects, by their whole texts.

    * null texts are judged as empty; null ids and repeated rows stay or go by their text.
    * ties: a score at the threshold stays.
    * no rows: none come back; other columns pass through, whatever their names.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id.

    * null and empty texts are one group; a group without any id keeps one of its rows.
    * ties: of rows with the same text and id, any one stays; repeated rows are such.
    * very long texts are compared by their recipes of chunks, whole.
    * no rows: none come back; other columns pass through, whatever their names.
    """
    kept = exact_dedup(docs).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)  # as exact_dedup has it
    return _chosen(_whole(docs, doc_id=F.col("doc_id"), sha=digest), kept, ["doc_id", "sha"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    * null or wordless texts and null ids are linked with nothing: all of them stay.
    * rows that share a doc_id but differ in text are documents of their own.
    * ties: of texts with the smallest id, that with the least hash; of repeated rows, one.
    * very long texts are compared by all of their shingles.
    * no rows: none come back; other columns pass through, whatever their names.
    """
    return _chosen(_whole(docs, doc_id=F.col("doc_id").cast("long"), th=text_hash(F.col("text"))), near_kept(docs), ["doc_id", "th"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole copies by a hash of its id: none, once or twice.

    * null or wordless texts are not taken; a null source is one of its own.
    * rows that share a doc_id, or have none, share its ratio.
    * ties: equal ids have equal hashes, so reruns agree.
    * very long texts are counted whole and taken whole.
    * no rows: none come back; other columns pass through, whatever their names.
    """
    taken = mix_sources(docs).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).filter("size > 0")
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 11) / float(1 << 53)
    ratio = F.col("taken") / F.col("size")
    copies = F.floor(ratio) + F.when(u < ratio - F.floor(ratio), 1).otherwise(0)
    taken = taken.select(F.col("doc_id").alias("of_id"), copies.cast("int").alias("copies")).filter("copies > 0")
    worded = docs.filter(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")))
    joined = _whole(worded, id=F.col("doc_id")).join(taken.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 1024 tokens; see pack() for nulls, ties, long texts, repeated rows and no rows."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("pack", pack_sequences),
]

#: The stages learn, sketch and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
