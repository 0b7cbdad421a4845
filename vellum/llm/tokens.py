"""Token counts: ids of a public tokenizer, and exact statistics from the histogram of encoded lengths."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from vellum.llm.common import cut, map_arrow

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Lengths in one block of the suffix sums.
BLOCK = 64


class Encoder:
    """Ids just as tokenizers gives them with add_special_tokens=False.

    A byte-level file whose ranks lie beside it (.tiktoken) is encoded by these, which
    give the same ids several times faster; a text that contains an added token goes to
    tokenizers itself.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return np.array(self.fast.encode_ordinary(text), dtype=np.int64)


def token_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """doc_id, n_tokens; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            n = [len(encoder.ids(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")), run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """The exact histogram and its suffix sums, one row per distinct length.

    length, n_docs; docs_longer and tokens_longer: documents longer than this and their
    tokens; docs_total and tokens_total; truncated_tokens: the tokens kept if every
    document were cut to this length; cut_tokens: those lost; cdf: the share of
    documents that fit whole.

    The suffix sums go by blocks of BLOCK lengths, so no task holds more than a block of
    the histogram or one row a block. Null lengths are left out; an empty table gives no rows.
    """
    hist = cut(lengths.filter(F.col(length).isNotNull()).groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")])
    sums = hist.agg(F.sum("n_docs").alias("docs_total"), F.sum("tokens").alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c, total: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(total)
    out = hist.join(blocks, "block").withColumn("docs_longer", longer("n_docs", "d_above")).withColumn("tokens_longer", longer("tokens", "t_above"))
    out = out.join(F.broadcast(sums))  # one row
    kept = F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")
    return out.select(
        "length", "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        kept.alias("truncated_tokens"), (F.col("tokens_total") - kept).alias("cut_tokens"), (1 - F.col("docs_longer") / F.col("docs_total")).alias("cdf"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens for any context limits, from the histogram alone.

    With h the greatest length not above the limit: documents over the limit are those
    longer than h, and each keeps `limit` tokens.
    """
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    known = histogram.select("length", "docs_longer", "tokens_longer", "docs_total", "tokens_total")
    joined = F.broadcast(asked).join(known, F.col("length") <= F.col("limit"), "left")
    best = joined.groupBy("limit").agg(F.max_by(F.struct("docs_longer", "tokens_longer"), "length").alias("b"))
    whole = histogram.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"))
    over = F.coalesce("b.docs_longer", "d", F.lit(0))
    kept = F.coalesce(F.col("t"), F.lit(0)) - F.coalesce("b.tokens_longer", "t", F.lit(0)) + over * F.col("limit")
    return best.join(F.broadcast(whole)).select("limit", over.alias("docs_over"), kept.alias("truncated_tokens"))


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of all documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    fits = F.broadcast(asked).join(histogram, F.col("docs_total") - F.col("docs_longer") >= F.col("share") * F.col("docs_total"), "left")
    return fits.groupBy("share").agg(F.min("length").alias("length"))
