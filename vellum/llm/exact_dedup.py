"""Exact deduplication by content-defined chunk recipes (native: DataFrame functions only).

Every text is cut where its own content says so (where characters repeat at a fixed
distance, in any script, between a least and a greatest chunk length), each distinct chunk gets an identifier, and a text is described by
its recipe, the ordered list of chunk identifiers. Equal recipes mean equal texts once the
identifiers are verified: chunk contents are deduplicated under their identifiers in one
shuffle, and an identifier found with two different contents makes all identifiers longer
until none clashes. After that, only recipes are moved, grouped and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, join_groups, lower_ascii

LEAST_CHUNK, MOST_CHUNK = 768, 4096
#: A chunk ends where two characters stand again three places on, or one from U+2E80 (scripts of thousands of characters): about once in a few hundred characters.
END, END_LENGTH = r"(?:(.)(.).\1\2|([\x{2E80}-\x{10FFFF}])...\3)", 5


def chunks(text: Column, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; joined together they are the text. An empty text has none."""
    low, high = max(0, least - END_LENGTH), most - END_LENGTH
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{low},{high}}}?{END}|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column, words: int, bits: int) -> Column:
    """An identifier of `words` independent 64-bit hashes, each cut to `bits`."""
    parts = [F.shiftrightunsigned(F.xxhash64(F.lit(k), chunk), 64 - bits) for k in range(words)]
    return F.struct(*[p.alias(f"h{k}") for k, p in enumerate(parts)])


def recipes(docs: DataFrame, text: str, words: int, bits: int, least: int, most: int) -> DataFrame:
    """docs with its chunks replaced by the recipe and the SHA-256 of the normalised text."""
    norm = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    return docs.select(
        "doc_id",
        F.transform(chunks(norm, least, most), lambda c: identifier(c, words, bits)).alias("recipe"),
        F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
    )


def clashes(docs: DataFrame, text: str, words: int, bits: int, least: int, most: int) -> DataFrame:
    """Identifiers that stand for more than one distinct chunk content."""
    norm = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    pieces = docs.select(F.explode(chunks(norm, least, most)).alias("chunk"))
    distinct = pieces.select(identifier(F.col("chunk"), words, bits).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")


def exact_dedup(docs: DataFrame, text: str = "text", words: int = 2, bits: int = 64, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the row
    with the largest doc_id stays.

    * null text: as empty; all empty texts form one group.
    * null doc_id: counts in group_size, never the keeper unless the whole group has no id
      (then keep_id is null and its rows are kept).
    * repeated rows (same doc_id and text): both count, and both carry kept = true; so are
      rows that tie for the largest doc_id.
    * very long texts: chunked whole; the recipe of one text is in one task's memory.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", F.col(text).alias("_text"))
    while not clashes(docs, "_text", words, bits, least, most).isEmpty():
        words += 1
    made = cut(recipes(docs, "_text", words, bits, least, most))
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = join_groups(made, groups, "recipe", "group_size", made.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
