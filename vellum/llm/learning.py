"""What the trained operators share: folds by id, labelled rows, bounded samples of them, and class priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import join_groups


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, which: int) -> Column:
    """False for a null id, which is never learnt from either."""
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def sampled(rows: DataFrame, by: str, per_class: int, order: Column) -> DataFrame:
    """The `per_class` rows of each value of `by` whose `order`, a hash of the whole row, is least; of equal rows one.

    The bound is exact, whatever the number of classes and however often a row repeats: a
    threshold by the class's count leaves about twice as many, and only these are ranked.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_class_rows"))
    total = rows.count()
    u = F.shiftrightunsigned(order, 11) / float(1 << 53)
    near = join_groups(rows.withColumn("_u", u), counts, by, "_class_rows", total).filter(F.col("_u") * F.col("_class_rows") < 2 * per_class + 64)
    once = near.drop("_class_rows").dropDuplicates([by, "_u"])
    place = F.row_number().over(Window.partitionBy(by).orderBy("_u"))
    return once.withColumn("_place", place).filter(F.col("_place") <= per_class).drop("_u", "_place")


def taught(docs: DataFrame, text: str, labels: DataFrame, column: str, folds: int, which: int, per_class: int, salt: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, _text of at most `per_class` labelled ids of each class outside the held-out fold, one text an id (the least by hash); and how many ids are labelled so."""
    known = labelled(labels, column, folds, which)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # 0 and 1
    some = sampled(known, "y", per_class, F.xxhash64(F.lit(salt), "doc_id"))
    met = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(some), "doc_id")  # at most 2 * per_class rows
    return met.groupBy("doc_id", "y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")), counts


def taught_whole(docs: DataFrame, text: str, labels: DataFrame, column: str, folds: int, which: int) -> DataFrame:
    """doc_id, y, _text of every labelled id outside the held-out fold that has a row, in the order of ids within partitions; one text an id (the least by hash).

    An id's rows are merged before they move, so no id is hot.
    """
    own = docs.select("doc_id", F.col(text).alias("_text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, which))
    once = own.groupBy("doc_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return once.join(labelled(labels, column, folds, which).hint("shuffle_hash"), "doc_id").sortWithinPartitions("doc_id").select("doc_id", "y", "_text")


def labelled(labels: DataFrame, column: str, folds: int, which: int) -> DataFrame:
    """doc_id, y: ids outside the held-out fold with a label of 0 or 1; an id with both is left out."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"), folds, which))
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))
