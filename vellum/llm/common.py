"""Helpers shared by the corpus operators: durable cuts of lineage, hot-key-safe
joins and prefix sums, and Arrow plumbing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.session import BATCH_BYTES, shared_dir, small_batches
from vellum.session import release as release
from vellum.session import stored as stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a function sees at once, of at most BATCH_BYTES bytes.
BATCH_ROWS = 256
#: Narrow rows that a task takes at least, where there are more tasks than cores.
TASK_ROWS = 20_000
#: A group with at least 1/HEAVY of all rows is heavy; there are at most HEAVY of them.
HEAVY = 1000


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """df, of about so many rows, in a task for every task_rows of them, but as many as there are cores: partitions of a shuffle are read together if they hold less.

    Not for a shuffled hash join: a task keeps its tables until it ends. Where partitions outnumber what small tables need, and adaptive execution doesn't merge them, the time of a step goes in tasks without rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / task_rows)))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BATCH_ROWS rows and, but for single rows above it, about BATCH_BYTES bytes."""
    start, n = 0, batch.num_rows
    while start < n:
        rows = min(BATCH_ROWS, n - start)
        while rows > 1 and batch.slice(start, rows).nbytes > BATCH_BYTES:
            rows = (rows + 1) // 2
        yield batch.slice(start, rows)
        start += rows


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small portions, so that a worker's memory does not follow from the batch size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(p for batch in batches for p in portions(batch))

    return df.mapInArrow(run, schema)


def bits_for(rows: int) -> int:
    """Buckets as a power of two, about the square root of the rows, so that both levels of a prefix sum stay even."""
    return min(24, max(4, math.ceil(math.log2(max(rows, 1)) / 2)))


def prefix_sums(df: DataFrame, part: list[str], bucket: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add for every value column its exclusive prefix sum within `part`, in the order of (bucket, order).

    Two levels: bucket totals are summed first, then rows within each bucket. No task
    holds more than one bucket of a part, however many rows that part has. `bucket` must
    not decrease along the order. `part` columns must not be null.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*part, "_bucket"]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{out}") for out, v in values.items()])
    over = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{out}").over(over), F.lit(0)).alias(f"_o_{out}") for out in values])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, keys)
    for out, v in values.items():
        joined = joined.withColumn(out, F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_o_{out}"))
    return joined.drop("_bucket", *[f"_o_{out}" for out in values])


def global_rank(df: DataFrame, by: str) -> DataFrame:
    """Add `rank`, 0-based over all rows in the order of a unique column, without gathering the rows in one task."""
    placed = cut(df.repartitionByRange(F.col(by)).withColumn("_bucket", F.spark_partition_id()).withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0)))
    return prefix_sums(placed.withColumnRenamed("_bucket", "_place"), ["_all"], F.col("_place"), [by], {"rank": "_one"}).drop("_place", "_one", "_all")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row a key, `size` rows each) that survives hot keys.

    Groups of at least total/HEAVY rows, of which there can be at most HEAVY, are
    broadcast; all others are joined by a shuffle in which no key can be hot.
    """
    least = max(64, math.ceil(total / HEAVY))
    heavy, light = few(groups.filter(F.col(size) >= least), HEAVY), groups.filter(F.col(size) < least)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return few(hot.unionByName(rest), total)
