"""Best-fit packing with exact complements.

Documents become token pieces. The plan is made on the histogram of piece lengths alone
(at most `capacity` counts). Sums of one, two and three available lengths are indexed by
their value; the index follows the counts. The longest length opens sequences, and their
gap is looked up in the index: a combination that fills it exactly is consumed as often as
its counts allow. A gap without one takes the best fit, the longest length that still goes
in, and what is left of it is looked up again. Pieces are then dealt to the plan's slots by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bits_for, cut, map_arrow, prefix_sums
from vellum.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2
#: Tried by plan_sequences: a best fit that leaves at most so many tokens open goes before exact pairs and triples.
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity when there are several."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def pieces(docs: DataFrame, text: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.ids(body or ""), end_id).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    for to, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        to.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """Sums of one, two and three available lengths, by their value, under the counts `left`.

    have: the single lengths; pairs: how many available pairs have each sum, so that a sum
    of two or (less one length) of three is found by looking it up. Lengths that run out
    leave both.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.most = left, len(left) - 1
        self.have, self.pairs = left > 0, np.zeros(len(left), dtype=np.int64)
        lengths = np.flatnonzero(self.have)
        for i, a in enumerate(lengths):
            sums = a + lengths[:i]
            self.pairs[sums[sums <= self.most]] += 1
            self.pairs[2 * a : 2 * a + 1] += left[a] > 1

    def times(self, lengths: tuple[int, ...], most: int) -> int:
        """How many times the combination is available, at most `most`."""
        return min([most, *[int(self.left[x]) // lengths.count(x) for x in set(lengths)]])

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            before = int(self.left[x])
            self.left[x] = after = before - times
            if before > 1 >= after:
                self.pairs[2 * x : 2 * x + 1] -= 1
            if before > 0 >= after:
                self.have[x] = False
                self.pairs[x + np.flatnonzero(self.have[: self.most - x + 1])] -= 1

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Available a >= b with a + b = total and a <= most, a as long as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        found = a[self.have[a] & self.have[total - a]]
        found = found[(2 * found > total) | (self.left[found] > 1)]
        return (int(found[0]), int(total - found[0])) if len(found) else None

    def of(self, gap: int, longest: bool = False) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap exactly, the longest first; None if there are none. A triple goes before a pair if `longest` is asked and its first length is longer."""
        if self.have[gap]:
            return (gap,)
        two = self.pair(gap, gap)
        if two and not longest:
            return two
        a = np.flatnonzero(self.have[: max(0, gap - 1)])[::-1]
        for x in a[(3 * a >= gap) & (a > (two[0] if two else 0)) & (self.pairs[gap - a] > 0)].tolist():
            three = self.pair(gap - x, x)
            if three and self.left[x] > three.count(x):
                return (x, *three)
        return two


def plan_once(counts: dict[int, int], capacity: int, slack: int = 0, longest: bool = False) -> list[tuple[tuple[int, ...], int, int]]:
    """(lengths, times, closing): a plan, longest lengths first; closing is how many lengths the exact complement has that filled the sequence, 0 if none did.

    Every step exhausts the availability of some length or completes its sequences, so the
    plan has no more entries than a small multiple of the capacity, whatever the counts.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    index, plan = Complements(left), []
    for length in range(capacity, 0, -1):
        while left[length]:
            # A length may have to serve as its own partner: open only as many as leave enough of it.
            n = max(1, int(left[length]) // max(1, capacity // length))
            index.take((length,), n)
            todo = [((length,), n)]
            while todo:
                held, times = todo.pop()
                gap = capacity - sum(held)
                below = np.flatnonzero(index.have[: gap + 1])
                fit = int(below[-1]) if len(below) else 0
                if not fit:
                    plan.append((held, times, 0))
                    continue
                exact = index.of(gap, longest) if fit == gap or gap - fit > slack else None
                lengths = exact or ((fit,) if gap - fit <= slack else (fit,) * max(1, min(gap // fit, int(left[fit]) // times)))
                taken = index.times(lengths, times)
                index.take(lengths, taken)
                if exact:
                    plan.append((held + lengths, taken, len(lengths)))
                else:
                    todo.append((held + lengths, taken))
                if times > taken:
                    todo.append((held, times - taken))
    return plan


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int, int]]:
    """(lengths in a sequence, number of such sequences, closing): the shortest of the plans for several slacks and both orders of complements. counts: pieces by length."""
    size = lambda plan: sum(times for _, times, _ in plan)
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for slack in SLACKS:
        for longest in (False, True):
            plan = plan_once(counts, capacity, slack, longest)
            best = plan if best is None or size(plan) < size(best) else best
            if size(best) <= least:
                return best
    return best


def slots(spark: SparkSession, plan: list[tuple[tuple[int, ...], int, int]]) -> DataFrame:
    """length, low, high, sequence, offset, closing: pieces of a length with low <= rank < high go to sequence + (rank - low)."""
    rows, used, sequence = [], {}, 0
    for lengths, times, closing in plan:
        offset = 0
        for x in lengths:
            low = used.get(x, 0)
            rows.append((x, low, low + times, sequence, offset, closing))
            used[x], offset = low + times, offset + x
        sequence += times
    return spark.createDataFrame(rows, "length long, low long, high long, sequence long, offset long, closing int")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, closing: one row per piece.

    A document's ids, then end_id, go whole into one sequence of at most `capacity`
    tokens; only longer ones are cut. closing: how many lengths the exact complement has
    that filled the piece's sequence, 0 if none did.

    * null or empty text: one piece, the end id alone.
    * null doc_id: packed like any other. Repeated rows: each is packed.
    * ties: pieces of one length go by a hash of id, piece and ids; equal rows may change places.
    * very long texts are read whole, one at a time, and become as many pieces as they need.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, text, tokenizer, capacity, end_id))
    histogram = made.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most `capacity` rows
    total = sum(counts.values())
    order = made.withColumn("order", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(order, ["length"], F.shiftright("order", 64 - bits_for(total)), ["order", "doc_id", "piece"], {"rank": "one"})
    places = slots(spark, plan_sequences(counts, capacity))  # at most a small multiple of `capacity` rows
    out = ranked.join(F.broadcast(places), "length").filter("rank >= low AND rank < high")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", "closing")
