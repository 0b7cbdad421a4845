"""Quality by Bradley-Terry pairwise ranking.

A document has a strength, linear in features of its text: shares of kinds of bytes and
repeats, and hashed words. Strengths are learnt from preference pairs (a document labelled
good is preferred to one labelled bad) by logistic loss on the difference of their
features, over all pairs of all labelled documents. The score is a logistic of the strength,
shifted so that the strength at a chosen quantile of the training documents gets THRESHOLD.

The features of the labelled documents stay on the executors, in blocks. A Newton step takes
two passes over them: one for the slope and curvature, one for the strengths that steps of
several lengths would give. A document meets the other class as a histogram of strengths,
so a pass costs in proportion to the documents, not the pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BATCH_ROWS, map_arrow, release, small_batches, stored
from vellum.llm.learning import held_out, sigmoid, taught_whole

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Slots of hashed words (lower-cased A-Z), and distinct words whose slots a worker keeps.
SLOTS, CACHE = 512, 200_000
#: Documents of a block of features.
BLOCK = 2048
#: Newton steps at most, the gain of the loss that ends them, the lengths tried for each, and the ridge.
STEPS, GAIN, LENGTHS, RIDGE = 30, 1e-6, (1.0, 0.5, 0.25, 0.125, 0.03125), 1e-3
#: Ends of the histogram's bins of strengths, finer around 0, and the wider bins of the curvature.
EDGES, WIDE = np.sinh(np.linspace(-9, 9, 2047)) / 16, 128
BINS = len(EDGES) + 1
_SPACE = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:?'\"()-"
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PLAIN)
_RUNS = re.compile(rb"([!-/:-@\[-`{-~])\1")
SHARES = (
    "upper", "shouting", "symbols", "symbol_words", "punctuation", "digits", "repeats", "distinct", "pairs", "word_length", "long_words", "lines", "line_repeats", "length", "runs", "control",
    "some_upper", "some_symbols", "some_repeats", "some_runs",
)
FEATURES = len(SHARES) + SLOTS
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _of(text: bytes, kind: bytes) -> int:
    return len(text) - len(text.translate(None, kind))


def shares(text: bytes | None) -> list[float]:
    """Shares in 0..1 of the whole text; the last are saturated, so that a small share already shows."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, w = max(1, len(text) - _of(text, _SPACE)), max(1, len(words))
    upper, lower = _of(text, _UPPER), _of(text, _LOWER)
    symbols, runs = _of(text, _SYMBOLS) / n, len(_RUNS.findall(text)) / w
    up, same = upper / max(1, upper + lower), sum(map(bytes.__eq__, words, words[1:])) / w
    kinds = len(set(words))
    return [
        up, float(up > 0.5), symbols, sum(1 for x in words if x[-1] in _SYMBOLS) / w, _of(text, _PLAIN) / n, _of(text, _DIGIT) / n, same, kinds / w, len(set(zip(words, words[1:], strict=False))) / w,
        min(1.0, len(text) / w / 20), sum(1 for x in words if len(x) > 25) / w, min(1.0, len(lines) / w), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, np.log1p(len(words)) / 12), min(1.0, runs), _of(text, bytes(range(9)) + b"\x7f") / n,
        up / (up + 0.1), symbols / (symbols + 0.02), same / (same + 0.05), runs / (runs + 0.05),
    ]


class Featurer:
    """Texts to rows of FEATURES: the shares, then the root of each slot's share of the words."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def of(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES), np.float32)
        for row, text in zip(out, texts, strict=True):
            row[: len(SHARES)] = shares(text)
            words = (text or b"").translate(_SMALL).split()
            if len(self.seen) > CACHE:
                self.seen.clear()
            for w in set(words):
                if w not in self.seen:
                    self.seen[w] = xxhash.xxh64_intdigest(w, 9) % SLOTS
            slots = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            row[len(SHARES) :] = np.sqrt(np.bincount(slots, minlength=SLOTS) / max(1, len(words)))
        return out


#: What a pass makes of a block (its features; true where good): numbers to add, many small ones to add in single precision, numbers to take the least of.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Pass = Callable[[np.ndarray, np.ndarray], Found]
NONE = np.empty(0)


def add(one: Found, two: Found) -> Found:
    return one[0] + two[0], one[1] + two[1], np.minimum(one[2], two[2])


def moments(x: np.ndarray, good: np.ndarray) -> Found:
    # Column by column: no second copy in double precision.
    return np.concatenate([[good.sum(), (~good).sum()], x.sum(axis=0, dtype=np.float64), [np.square(c, dtype=np.float64).sum() for c in x.T]]), NONE, NONE


def histogram(s: np.ndarray, good: np.ndarray) -> np.ndarray:
    """By class (bad, good) and bin of EDGES: the number of strengths, and their sum."""
    at = np.searchsorted(EDGES, s) + BINS * good
    return np.stack([np.bincount(at, minlength=2 * BINS), np.bincount(at, s, 2 * BINS)]).reshape(2, 2, BINS)


def summed(f: Callable[[np.ndarray], np.ndarray], at: np.ndarray, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of `at` the sum of f(at - place) over n documents at each place."""
    return np.concatenate([NONE, *[f(at[i : i + 256, None] - places) @ n for i in range(0, len(at), 256)]])


def bell(d: np.ndarray) -> np.ndarray:
    p = sigmoid(d)
    return p * (1 - p)


class Rivals:
    """What all pairs say, of a histogram: their mean loss, and each document's pull and curvature by its strength."""

    def __init__(self, seen: np.ndarray):
        counts, sums = seen
        self.some = counts > 0
        self.n = [c[k] for c, k in zip(counts, self.some, strict=True)]
        self.places = [s[k] / n for s, k, n in zip(sums, self.some, self.n, strict=True)]
        self.pairs = max(1.0, float(self.n[0].sum() * self.n[1].sum()))

    def loss(self) -> float:
        return float(self.n[1] @ summed(lambda d: np.logaddexp(0, -d), self.places[1], self.places[0], self.n[0])) / self.pairs

    def pulls(self) -> np.ndarray:
        """At EDGES, by class: the slope of the mean loss by the strength of one document."""
        return np.stack([summed(sigmoid, EDGES, self.places[1], self.n[1]), -summed(lambda d: sigmoid(-d), EDGES, self.places[0], self.n[0])]) / self.pairs

    def curves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wide bin of each bin; by class and wide bin one document's curvature; by pairs of wide bins that of one pair."""
        low, high = min(p.min() for p in self.places), max(p.max() for p in self.places)
        middles = low + (high - low) * (np.arange(WIDE) + 0.5) / WIDE
        wide = np.searchsorted((middles[1:] + middles[:-1]) / 2, np.clip(np.concatenate([EDGES, EDGES[-1:]]), low, high))
        both = bell(middles[:, None] - middles) / self.pairs
        n = [np.bincount(wide[k], c, WIDE) for k, c in zip(self.some, self.n, strict=True)]
        return wide, np.stack([both @ n[1], both @ n[0]]), both


class PairRanker:
    """weights, centre and spread of the strengths; offset and scale of the score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share_bad: float | None = None):
        """Of one block."""
        self.learn(lambda f: f(x.astype(np.float32), y == 1), x.shape[1], share_bad)

    @classmethod
    def of(cls, blocks: DataFrame) -> PairRanker:
        out = cls.__new__(cls)
        out.learn(lambda f: totals(blocks, f), FEATURES, None)
        return out

    def learn(self, over: Callable[[Pass], Found], n: int, share_bad: float | None) -> None:
        """over: runs a pass over all blocks. share_bad: the share of documents below the cut, that of the bad ones if None."""
        self.weights, self.centre, self.spread, self.scale, self.shift = np.zeros(n), np.zeros(n), np.ones(n), 1.0, 0.0
        found = over(moments)[0]
        good, bad = found[:2]
        if not good or not bad:
            self.shift = 6.0 if good or not bad else -6.0
            return
        self.centre = found[2 : 2 + n] / (good + bad)
        self.spread = np.sqrt(np.maximum(0, found[2 + n :] / (good + bad) - self.centre**2)) + 1e-3
        # Slots share one spread: a rare word must not weigh more for being rare.
        self.spread[len(SHARES) :] = max(1e-3, float(self.spread[len(SHARES) :].mean())) * 4 if n > len(SHARES) else 1.0
        rivals = Rivals(histogram(np.zeros(2), np.array([False, True])) * np.array([bad, good])[:, None])
        loss = rivals.loss()
        for _ in range(STEPS):
            slope, curve = self.newton(over, rivals)
            step = -np.linalg.solve(curve, slope)
            seen = over(self.tried(step))[0].reshape(len(LENGTHS), 2, 2, BINS)
            best = min(((r := Rivals(h)).loss() + self.ridge(self.weights + k * step), i, r) for i, (k, h) in enumerate(zip(LENGTHS, seen, strict=True)))
            if best[0] >= loss:
                break
            gain, loss, rivals = loss - best[0], best[0], best[2]
            self.weights = self.weights + LENGTHS[best[1]] * step
            if gain < GAIN:
                break
        below = bad if share_bad is None else share_bad * (good + bad)
        middle, deviation = self.cut(over, int(np.clip(round(below), 1, good + bad - 1)))
        self.scale = 4.0 / max(1e-6, deviation)
        self.shift = np.log(THRESHOLD / (1 - THRESHOLD)) - self.scale * middle

    def ridge(self, w: np.ndarray) -> float:
        return RIDGE / 2 * float(w @ w)

    def newton(self, over: Callable[[Pass], Found], rivals: Rivals) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the mean loss over all pairs, with the ridge. The curvature takes strengths by wide bins, alike in all its terms, so it is positive."""
        n, pulls, (wide, curves, both) = len(self.weights), rivals.pulls(), rivals.curves()
        strength, centre, spread = self.strength, self.centre.astype(np.float32), self.spread.astype(np.float32)
        upper = np.triu_indices(n)

        def run(x: np.ndarray, good: np.ndarray) -> Found:
            s = strength(x)
            z = (x - centre) / spread
            pull = np.where(good, np.interp(s, EDGES, pulls[1]), np.interp(s, EDGES, pulls[0]))
            at, kind = wide[np.searchsorted(EDGES, s)], good.astype(int)
            member = np.zeros((len(x), 2 * WIDE), np.float32)
            member[np.arange(len(x)), at + WIDE * kind] = 1
            # In units of a document's share, so that single precision holds them.
            square = (z * curves[kind, at].astype(np.float32)[:, None]).T @ z
            return pull @ z, np.concatenate([square[upper], (member.T @ z).ravel()]), NONE

        slope, bulk, _ = over(run)
        square = np.zeros((n, n))
        square[upper] = bulk[: len(upper[0])]
        square += np.triu(square, 1).T
        sums = bulk[len(upper[0]) :].reshape(2, WIDE, n).astype(np.float64)
        cross = sums[1].T @ both @ sums[0]
        return slope + RIDGE * self.weights, square - cross - cross.T + RIDGE * np.eye(n)

    def tried(self, step: np.ndarray) -> Pass:
        """The histograms of the strengths after a step of each of LENGTHS."""
        strength, slope = self.strength, step / self.spread
        base = float(self.centre @ slope)

        def run(x: np.ndarray, good: np.ndarray) -> Found:
            s, d = strength(x), x @ slope - base
            return np.concatenate([histogram(s + k * d, good).ravel() for k in LENGTHS]), NONE, NONE

        return run

    def cut(self, over: Callable[[Pass], Found], below: int) -> tuple[float, float]:
        """Half way between the `below` lowest strengths and the next, exactly; and the deviation of all. Bins are split until the two are apart or equal."""
        edges, strength = EDGES, self.strength
        while True:

            def run(x: np.ndarray, good: np.ndarray, edges: np.ndarray = edges) -> Found:
                s = strength(x)
                at, ends = np.searchsorted(edges, s), np.full((2, BINS), np.inf)
                np.minimum.at(ends[0], at, s)
                np.minimum.at(ends[1], at, -s)
                return np.concatenate([np.bincount(at, minlength=BINS), [s.sum(), s @ s]]), NONE, ends.ravel()

            sums, _, ends = over(run)
            low, high = ends[:BINS], -ends[BINS:]
            reach = np.cumsum(sums[:BINS])
            one, two = np.searchsorted(reach, [below, below + 1])
            if one < two or low[one] == high[one]:
                mean = sums[BINS] / reach[-1]
                return (high[one] + low[two]) / 2, math.sqrt(max(0.0, sums[BINS + 1] / reach[-1] - mean**2))
            edges = np.linspace(low[one], high[one], len(EDGES))

    def pair_loss(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient and value of the mean logistic loss over the given pairs (first is preferred to second), with a ridge: the plain form, for tests of newton() and Rivals. Each row's pull is summed over its pairs, so no differences are made."""
        s = x @ self.weights
        d = s[first] - s[second]
        pull = (sigmoid(d) - 1) / len(d)
        per = np.bincount(first, pull, len(x)) - np.bincount(second, pull, len(x))
        return per @ x + RIDGE * self.weights, float(np.logaddexp(0, -d).mean() + RIDGE / 2 * self.weights @ self.weights)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.spread @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.strength(x) + self.shift)

    def score(self, text: Column) -> Column:
        """The score of a text, as a column: only the text goes to Python."""

        @F.arrow_udf("double")
        def of(texts: pa.Array) -> pa.Array:
            found = Featurer()
            parts = [self.scores(found.of(texts.slice(i, BATCH_ROWS).to_pylist())) for i in range(0, len(texts), BATCH_ROWS)]
            return pa.array(np.concatenate([np.empty(0), *parts]))

        return of(text.cast("binary"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The features of rows (doc_id, y, _text), BLOCK documents a row: good, a byte a document, and x, FEATURES half-precision numbers a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, good, x, n = Featurer(), [], [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(good)], pa.binary()), pa.array([b"".join(x)], pa.binary())], names=["good", "x"])
        for batch in batches:
            good.append((batch.column(0).to_numpy() == 1).tobytes())
            x.append(found.of(batch.column(1).to_pylist()).astype("<f2").tobytes())
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                good, x, n = [], [], 0
        if n:
            yield block()

    return map_arrow(rows.select("y", F.col("_text").cast("binary")), run, "good binary, x binary")


def totals(blocks: DataFrame, f: Pass) -> Found:
    """A pass over all blocks: added up by task, then by about the root of the number of tasks, then here, always in the same order."""
    names, kinds = ("sums", "bulk", "least"), ("<f8", "<f4", "<f8")
    row = lambda place, found: pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *[pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in zip(found, kinds, strict=True)]], names=["place", *names])
    back = lambda got: tuple(np.frombuffer(got[c], k) for c, k in zip(names, kinds, strict=True))
    none = lambda: f(np.empty((0, FEATURES), np.float32), np.empty(0, bool))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for batch in batches:
            for got in batch.to_pylist():
                found = f(np.frombuffer(got["x"], "<f2").reshape(-1, FEATURES).astype(np.float32), np.frombuffer(got["good"], bool))
                all_ = found if all_ is None else add(all_, found)
        if all_ is not None:
            yield row(TaskContext.get().partitionId(), all_)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, all_ = 0, None
        for batch in batches:
            for got in batch.to_pylist():
                place, all_ = (got["place"], back(got)) if all_ is None else (place, add(all_, back(got)))
        if all_ is not None:
            yield row(place, all_)

    schema = "place int, sums binary, bulk binary, least binary"
    groups = math.ceil(math.sqrt(blocks.rdd.getNumPartitions()))
    by_task = map_arrow(blocks, each, schema)
    # Dealt by place, not by a key: so many tasks as there are groups, whatever the number of shuffle partitions.
    some = map_arrow(by_task.repartition(groups).sortWithinPartitions("place"), merged, schema)
    out = none()
    for got in sorted(some.toArrow().to_pylist(), key=lambda r: r["place"]):
        out = add(out, back(got))
    return out


def ranker(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", folds: int = FOLDS, which: int = HELD_OUT) -> PairRanker:
    """Fitted on all labelled ids outside the held-out fold that have a row."""
    small_batches(docs.sparkSession)
    blocks = stored(blocks_of(taught_whole(docs, text, labels, label, folds, which)), "quality-features")
    model = PairRanker.of(blocks)
    release(blocks)
    return model


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that quality_scores would reject; all columns as they were, whatever their names; no shuffle."""
    return docs.filter(ranker(docs, labels, text).score(F.col(text)) >= THRESHOLD)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", folds: int = FOLDS, which: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, from the whole text alone.

    * null text: scored as the empty text. null doc_id: scored, held_out false, never learnt from.
    * repeated rows: scored alike. An id with several texts is learnt from by one of them.
    * Labels other than 0 and 1, null, or contradictory for an id: not learnt from.
    * without labels of both kinds the score is a constant: high if only good documents,
      or none, are labelled; low if only bad ones are.
    * ties: equal features give equal scores; the cut lies half way between two strengths.
    * very long texts are read whole, one at a time.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = ranker(docs, labels, text, label, folds, which)
    scored = docs.select(F.col("doc_id").alias("doc_id"), model.score(F.col(text)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
