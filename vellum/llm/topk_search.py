"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging.

Queries are dealt into blocks and all rows into shards. Each (block, shard) tile is a
matrix product in one task, made in strips of queries; a tile keeps only each query's k
best rows by partial selection. The per-query lists are merged FAN_IN shards at a time, so that no task sees
more than FAN_IN * k rows of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a tile; queries whose scores a task holds at once; lists merged at once.
BLOCK_ROWS, SHARD_ROWS, STRIP_ROWS, FAN_IN = 8192, 8192, 512, 16
#: Products of doubles are exact up to here.
EXACT = 2.0**53
LONG = 2**63
TILE = "query_id long, shard int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and without a null or non-finite component."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks] or [np.empty(0)])
    return np.floor(flat.astype(np.float64) * 1024.0).reshape(rows, -1) if rows else flat.reshape(0, 0)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where these are exact, else Python integers clipped to the range of long."""
    most = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
    if q.shape[1] * most * most < EXACT:
        return (q @ c.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    return np.clip(a.dot(b.T), -LONG, LONG - 1).astype(np.int64)


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the lower position."""
    return best_of_each(score[None], k, np.zeros((1, len(score)), bool))[1]


def best_of_each(score: np.ndarray, k: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, positions) of each row's k highest scores, ties to the lower position, by partial selection; what `out` marks takes no part."""
    n = score.shape[1]
    if n <= k:
        return np.nonzero(~out)
    low = np.where(out, -LONG, score)
    least = np.partition(low, n - k, axis=1)[:, n - k, None]
    above, level = (low > least) & ~out, (low == least) & ~out
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))


def _tile(k: int):
    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending")])
        ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        parts = [(own[:0], ids[:0], np.empty(0, np.int64))]
        if len(ids) and len(own):
            asked, held = _matrix(queries["query"], len(own)), _matrix(rows["vector"], len(ids))
            for at in range(0, len(own), STRIP_ROWS):
                strip = own[at : at + STRIP_ROWS]
                score = scores(asked[at : at + STRIP_ROWS], held)
                row, place = best_of_each(score, k, strip[:, None] == ids[None, :])
                parts.append((strip[row], ids[place], score[row, place]))
        shard = rows["shard"][0].as_py() if len(ids) else 0
        q, i, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table([pa.array(q, pa.int64()), pa.array(np.full(len(q), shard), pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "shard", "vec_id", "score"])

    return tile


def topk_search(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    Components become floor(1024 * x). Candidates are all rows but those with the query's
    own vec_id; ties go to the smaller vec_id.

    * vectors that are null or hold a null or non-finite component, and rows with a null
      vec_id, take no part; a query left without candidates returns no row.
    * vectors of different lengths are never compared; scores beyond long are clipped to it.
    * repeated rows: each counts as a candidate; a query id that repeats is one query, by
      the least of its vectors.
    * an empty table gives no rows; other columns are ignored.
    """
    good = rows.filter(F.col("vec_id").isNotNull() & usable(F.col(vector)))
    kept = good.select("vec_id", F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dims"), is_query.alias("asks"))
    asked = kept.filter("asks").groupBy("vec_id").agg(F.min(F.struct("vector", "dims")).alias("m")).select("vec_id", "m.vector", "m.dims")
    n, n_asked = kept.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_asked / block_rows))
    of = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int")
    left = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("dims"), of(blocks, 1).alias("block"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = kept.select("vec_id", "vector", F.col("dims").alias("dims"), F.pmod(F.xxhash64(F.lit(2), "vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "shard", "dims"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), TILE)
    while True:
        shards = math.ceil(shards / FAN_IN)
        item = F.struct((-F.col("score")).alias("neg"), "vec_id", "score")
        merged = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.sort_array(F.collect_list(item)), 1, k).alias("top"))
        if shards <= 1:
            return merged.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).alias("rank"), "t.vec_id", "t.score")
        lists = merged.select("query_id", "shard", F.explode("top").alias("t")).select("query_id", "shard", "t.vec_id", "t.score")
