"""Reactive behaviour as streams over append-only feeds.

The status feed (seq, document_id, library_id, status) holds one row per change. Live
counts follow from the latest row of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.catalog import is_processing


def latest(feed: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values of each key's latest row; works on batches and streams."""
    newest = F.max_by(F.struct(*values), order)
    return feed.groupBy(key).agg(newest.alias("_v"), F.max(order).alias(order)).select(key, order, "_v.*")


def live_counts(feed: DataFrame) -> DataFrame:
    """library_id, indexed, processing from a batch of the status feed."""
    now = latest(feed, "document_id", "seq", "library_id", "status")
    return now.groupBy("library_id").agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(is_processing(F.col("status"))).alias("processing"))


def stream_counts(feed: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that keeps each document's latest status as state, and publishes the counts after every batch."""
    now = latest(feed, "document_id", "seq", "library_id", "status")
    counts = lambda batch, n: publish(batch.groupBy("library_id").agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(is_processing(F.col("status"))).alias("processing")), n)
    return now.writeStream.outputMode("complete").foreachBatch(counts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """The ingest queue: batches in order, each handled once; within a batch documents run in parallel. A batch that fails is tried again from the checkpoint."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str, ts: str, value: str, gap_ms: int = 300) -> DataFrame:
    """key, ts, value of the last event of each burst: those that no event of the same key follows within gap_ms."""
    ahead = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, value))
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    quiet = ahead.isNull() | (ms(ahead) - ms(F.col(ts)) > gap_ms)
    return events.withColumn("_quiet", quiet).filter("_quiet").select(key, ts, value)


def debounced_stream(events: DataFrame, key: str, ts: str, value: str, gap_ms: int = 300, late: str = "10 seconds") -> DataFrame:
    """The same on a stream, by session windows under a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{gap_ms} milliseconds")).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).select(key, ts, value)


def edges(counts: DataFrame, key: str, order: str, processing: str, indexed: str) -> DataFrame:
    """Adds `all_indexed` (a key's work was going on and has just ended) and `redirect` (the same with something indexed)."""
    before = F.lag(processing).over(Window.partitionBy(key).orderBy(order))
    ended = F.coalesce((before > 0) & (F.col(processing) == 0), F.lit(False))
    return counts.withColumn("all_indexed", ended).withColumn("redirect", ended & (F.col(indexed) > 0))
