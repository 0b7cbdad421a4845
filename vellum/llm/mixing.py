"""Mixing sources to target weights by a low-discrepancy schedule (native: DataFrame functions only).

Each source's documents are laid end to end in shuffled order on a line of words, cut into
equal blocks. Golden-ratio points, mapped through the cumulative demand of the sources,
deal slots to sources; slots are ranked within their source, and the slot of rank r takes
block r mod blocks. What a document gives is its overlap with the blocks taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bits_for, cut, global_rank, join_groups, prefix_sums

WEIGHTS = (3, 1, 2)
#: Three halves: the mix takes 150 % of all words.
SHARE_NUM, SHARE_DEN = 3, 2
#: A source may be taken this many times over.
MOST_TIMES = 2
BLOCK_WORDS, LEAST_BLOCKS = 65_536, 1024
GOLDEN = (math.sqrt(5) - 1) / 2
#: Words end at these; fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, source_size) with weight and target.

    Targets share SHARE of all words by weight; a target stops at MOST_TIMES its source's
    size and the excess is reshared by weight until none is above. Each pass is one small
    aggregate; a pass caps at least one more source, or is the last.
    """
    ranked = global_rank(sources, "key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, cap = 0.0, F.lit(MOST_TIMES) * F.col("source_size")
    capped = -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        n, held, open_weight = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (SHARE_NUM * total - SHARE_DEN * MOST_TIMES * held) / (SHARE_DEN * open_weight)
    return ranked.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def schedule(sources: DataFrame) -> DataFrame:
    """key, block, times: how often the schedule takes each block. sources: key, target, blocks, quota."""
    cumulated = cut(prefix_sums(sources.filter("quota > 0").withColumn("_all", F.lit(0)), ["_all"], F.shiftright(F.xxhash64("key"), 60), ["key"], {"low": "quota"}))
    demand = cumulated.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    points = demand + demand // 50 + 64 if demand else 0
    spark = sources.sparkSession
    # j = 2^20 * high + low keeps the fraction of j * GOLDEN precise for any j.
    high, low = F.shiftright("j", 20), F.col("j").bitwiseAND((1 << 20) - 1)
    frac = lambda x: x - F.floor(x)
    u = frac(frac(high * F.lit(math.fmod(GOLDEN * 2**20, 1.0))) + frac(low * F.lit(GOLDEN)))
    grid = 1 << 10
    slots = spark.range(points).withColumnRenamed("id", "j").withColumn("at", u * F.lit(float(demand)))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("at") * grid / max(demand, 1)), F.lit(grid - 1)))
    ranges = cumulated.select("key", "blocks", "quota", "low", (F.col("low") + F.col("quota")).alias("high"))
    cell = lambda x: F.least(F.floor(x * grid / max(demand, 1)), F.lit(grid - 1))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.greatest(cell(F.col("low")) - 1, F.lit(0)), F.least(cell(F.col("high")) + 1, F.lit(grid - 1)))))
    dealt = slots.join(ranges, "cell").filter("at >= low AND at < high").select("j", "key", "blocks", "quota").withColumn("one", F.lit(1).cast("long"))
    step = max(1, math.isqrt(points))
    ranked = prefix_sums(dealt, ["key"], F.floor(F.col("j") / step), ["j"], {"slot": "one"})
    return ranked.filter("slot < quota").groupBy("key", (F.col("slot") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size counts words of the text. `taken` is how many words of the row the mix takes,
    repeats counted; it never exceeds MOST_TIMES * size, each source's sum comes within
    about a block of its target, and reruns agree.

    * null text: size 0, taken 0. A source of size 0 has target 0.
    * null source: a source of its own, ordered last. null doc_id: a row like any other.
    * repeated rows: each is laid on the line by itself.
    * an empty table gives no rows; other columns are ignored.
    """
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), key.alias("key"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(rows.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id", "size")))
    n = rows.count()
    sized = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sized = targets(sized, weights)
    length = F.greatest(F.lit(1), F.least(F.lit(block_words).cast("long"), F.ceil(F.col("source_size") / least_blocks)))
    sized = sized.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5)).otherwise(0).cast("long")
    sources = cut(sized.withColumn("quota", F.least(quota, F.col("blocks") * MOST_TIMES)).select("key", "source_size", "source_rows", "target", "length", "blocks", "quota"))
    laid = prefix_sums(rows, ["key"], F.shiftright("order", 64 - bits_for(n)), ["order", "doc_id", "size"], {"start": "size"})
    laid = cut(join_groups(laid, sources.drop("blocks", "quota"), "key", "source_rows", n))
    some = laid.filter("size > 0")
    spans = some.select("key", "start", "size", "length", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    met = spans.join(schedule(sources), ["key", "block"])
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("start"), F.col("block") * F.col("length"))
    taken = met.groupBy("key", "start").agg(F.sum(inside * F.col("times")).alias("taken"))
    out = some.join(taken, ["key", "start"], "left").unionByName(laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
