"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms (words and word beginnings). Of a bounded
labelled sample, the terms that tell the classes apart, alone or by occurring together with
another one, are the machine's features: a weight for each and, for each two that occur
together, the inner product of their factors, so that pairs count that neither term alone
would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, map_arrow
from vellum.llm.learning import held_out, sigmoid, taught

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Labelled ids of each class in the sample; size of the feature table; least documents with a term; least |z| alone.
PER_CLASS, TERMS, LEAST_DOCS, LEAST_Z = 4000, 4096, 3, 4.0
#: Least root of the likelihood ratio (a |z| that also holds for rare pairs) of two terms' occurring together where neither tells alone.
PAIR_Z = 6.0
FACTORS, STEPS, RATE, RIDGE = 8, 300, 0.05, 1e-4
HASH_BITS = 24
#: Beginnings of a word, in bytes, that are terms too.
STEMS = (4, 5, 6)
PAIR_STEM = 5
CACHE = 200_000
#: Entries of the sample's term lists that are looked up at once.
SPAN = 1 << 20
#: Bytes outside words become spaces: words are letters a-z (after lower-casing A-Z) and all bytes from 0x80.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_WORDS).split())


def terms_of(word: bytes) -> list[int]:
    """The hashed terms of a word: itself and its beginnings."""
    mask = (1 << HASH_BITS) - 1
    return [xxhash.xxh64_intdigest(word, 0) & mask, *[xxhash.xxh64_intdigest(word[:k], k) & mask for k in STEMS if len(word) >= k]]


def pair_terms_of(word: bytes) -> list[int]:
    """The one term of a word that is counted with others: its beginning of PAIR_STEM bytes, or a shorter word itself."""
    mask = (1 << HASH_BITS) - 1
    return [(xxhash.xxh64_intdigest(word[:PAIR_STEM], PAIR_STEM) if len(word) >= PAIR_STEM else xxhash.xxh64_intdigest(word, 0)) & mask]


class Terms:
    """Documents to their sorted terms, or to places of the kept ones, through a bounded cache of words."""

    def __init__(self, kept: dict[int, int] | None = None, of: Callable[[bytes], list[int]] = terms_of):
        self.kept, self.terms_of, self.seen = kept, of, {}

    def of(self, text: bytes | None) -> list[int]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, kept, out = self.seen, self.kept, set()
        for w in words_of(text):
            hit = seen.get(w)
            if hit is None:
                found = self.terms_of(w)
                hit = seen[w] = tuple(found if kept is None else [kept[t] for t in found if t in kept])
            if hit:
                out.update(hit)
        return sorted(out)


class Sample:
    """Term lists of labelled documents, end to end: flat, and the document of each entry; y by document."""

    def __init__(self, lists: pa.ChunkedArray, y: np.ndarray):
        self.y = y == 1
        self.n1, self.n0 = int(self.y.sum()), int((~self.y).sum())
        self.flat = np.concatenate([np.empty(0, np.int32), *[c.flatten().to_numpy() for c in lists.chunks]])
        self.sizes = np.concatenate([np.empty(0, np.int64), *[c.value_lengths().to_numpy() for c in lists.chunks]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def only(self, terms: np.ndarray) -> list[np.ndarray]:
        """Each document's places among these sorted terms. Looked up SPAN entries at a time."""
        places, docs, terms = [np.empty(0, np.int64)], [np.empty(0, np.int32)], terms.astype(np.int32)
        for low in range(0, len(self.flat) if len(terms) else 0, SPAN):
            part = self.flat[low : low + SPAN]
            at = np.minimum(np.searchsorted(terms, part), len(terms) - 1)
            hit = terms[at] == part
            places.append(at[hit])
            docs.append(self.doc[low : low + SPAN][hit])
        return np.split(np.concatenate(places), np.cumsum(np.bincount(np.concatenate(docs), minlength=len(self.y)))[:-1])

    def rated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All terms of LEAST_DOCS documents or more, with the documents that have them and the |z| of the classes' shares."""
        terms, n = np.unique(self.flat, return_counts=True)
        toxic, of = np.unique(self.flat[self.y[self.doc]], return_counts=True)
        a = np.zeros(len(terms))
        a[np.searchsorted(terms, toxic)] = of
        p = n / (self.n0 + self.n1)
        z = np.abs(a / self.n1 - (n - a) / self.n0) / np.sqrt(p * (1 - p) * (1 / self.n1 + 1 / self.n0) + 1e-9)
        some = n >= LEAST_DOCS
        return terms[some], n[some], z[some]


def sampled_terms(rows: DataFrame) -> tuple[Sample, Sample]:
    """All terms, and those that are counted in pairs, of the sample's whole texts. rows: doc_id, y, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, paired, kind = Terms(), Terms(of=pair_terms_of), pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([every.of(t) for t in texts], kind), pa.array([paired.of(t) for t in texts], kind)], names=["doc_id", "y", "terms", "paired"])

    made = map_arrow(rows.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), F.col("_text").cast("binary")), run, "doc_id long, y int, terms array<int>, paired array<int>")
    got = cut(made).toArrow().sort_by("doc_id")  # at most 2 * PER_CLASS rows
    return tuple(Sample(got[c], got["y"].to_numpy()) for c in ("terms", "paired"))


class FactorizationMachine:
    """Binary features: logit = bias + sum w_i + sum over pairs i < j of <v_i, v_j>."""

    def __init__(self, n: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.bias + self.w[r].sum() + 0.5 * ((s := self.v[r].sum(axis=0)) @ s - (self.v[r] ** 2).sum()) if len(r) else self.bias for r in rows])

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Full-batch Adam on the logistic loss with a ridge, classes weighted alike."""
        if not len(rows):
            return
        flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        theta = [np.array([self.bias]), self.w, self.v]
        m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, STEPS + 1):
            vx = self.v[flat]
            s = np.zeros((len(rows), FACTORS))
            np.add.at(s, doc, vx)
            squares = np.bincount(doc, (vx**2).sum(axis=1), len(rows))
            z = theta[0][0] + np.bincount(doc, self.w[flat], len(rows)) + 0.5 * ((s**2).sum(axis=1) - squares)
            g = weight * (sigmoid(z) - y)
            gv = np.zeros_like(self.v)
            np.add.at(gv, flat, g[doc][:, None] * (s[doc] - vx))
            grads = [np.array([g.sum()]), np.bincount(flat, g[doc], len(self.w)) + RIDGE * self.w, gv + RIDGE * self.v]
            for t, d, a, b in zip(theta, grads, m1, m2, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                t -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.bias = float(theta[0][0])


def telling_terms(every: Sample, paired: Sample) -> np.ndarray:
    """The hashed terms whose frequency, or whose pair's, differs most between the classes, at most TERMS."""
    if not every.n1 or not every.n0:
        return np.empty(0, np.int64)
    terms, _, z = every.rated()
    best = dict(zip(terms[z >= LEAST_Z].tolist(), z[z >= LEAST_Z].tolist(), strict=True))
    terms, n, z = paired.rated()
    # No pair occurs more often than its terms: those too rare for PAIR_Z even if all in one class are no candidates.
    rest = terms[(z < LEAST_Z) & (n >= least_docs(paired))]
    best |= telling_pairs(paired, rest)
    return np.array(sorted(sorted(best, key=lambda t: (-best[t], t))[:TERMS]), dtype=np.int64)


def least_docs(sample: Sample) -> float:
    return PAIR_Z**2 / (2 * np.log((sample.n0 + sample.n1) / min(sample.n0, sample.n1)))


def ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio for a of n1 toxic and b of n0 clean documents, against one share for both."""
    part = lambda k, n, of: k * np.log(np.maximum(k, 1e-300) * (n1 + n0) / (n * np.maximum(of, 1e-300)))
    both, none = a + b, n1 + n0 - a - b
    return 2 * (part(a, n1, both) + part(b, n0, both) + part(n1 - a, n1, none) + part(n0 - b, n0, none))


def telling_pairs(sample: Sample, candidates: np.ndarray) -> dict[int, float]:
    """The candidates that tell the classes apart together with another one, with the highest root of their pairs' ratios.

    All pairs that occur are counted: for each candidate, the terms of its documents. Terms of
    the same documents are counted as one.
    """
    lists = sample.only(candidates)
    flat, doc = np.concatenate([np.empty(0, np.int64), *lists]), np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    order = np.argsort(flat, kind="stable")
    places = np.split(doc[order], np.cumsum(np.bincount(flat, minlength=len(candidates)))[:-1]) if len(candidates) else []
    first: dict[bytes, int] = {}
    same = np.array([first.setdefault(d.tobytes(), len(first)) for d in places], dtype=np.int64)
    docs_of = dict(zip(same.tolist(), places, strict=True))
    # Once for all terms: the documents' terms, each held once, toxic ones shifted by the number of terms.
    held = [np.unique(same[t]) + len(first) * toxic for t, toxic in zip(lists, sample.y.tolist(), strict=True)]
    most, least = np.zeros(len(first)), least_docs(sample)
    for k, own in docs_of.items():
        clean, toxic = np.bincount(np.concatenate([held[d] for d in own.tolist()]), minlength=2 * len(first)).reshape(2, -1)
        near = np.flatnonzero(clean + toxic >= least)
        near = near[near != k]
        if len(near):
            most[k] = np.sqrt(max(0.0, ratio(toxic[near], clean[near], sample.n1, sample.n0).max()))
    return {t: m for t, m in zip(candidates.tolist(), most[same].tolist(), strict=True) if m >= PAIR_Z}


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", folds: int = FOLDS, which: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, from the whole text alone.

    * null text: scored as the empty text. null doc_id: scored, held_out false, never learnt from.
    * repeated rows: scored alike. An id with several texts is learnt from by one of them.
    * Labels other than 0 and 1, null, or contradictory for an id: not learnt from.
    * without labels of both kinds every score is the bias: low unless only toxic documents are labelled.
    * where no term tells the classes apart, every score is the share of toxic labels (of one clean label more).
    * ties: terms that tell alike go by hash; equal sets of terms give equal scores.
    * very long texts are read whole, one at a time.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows, counts = taught(docs, text, labels, label, folds, which, PER_CLASS, 6)
    every, paired = sampled_terms(rows)
    places = telling_terms(every, paired)
    kept = {int(t): i for i, t in enumerate(places)}
    model = FactorizationMachine(len(kept))
    if counts.get(0) and counts.get(1) and not kept:
        model.bias = float(np.log(counts[1] / (counts[0] + 1)))
    elif counts.get(0) and counts.get(1):
        model.fit(every.only(places), every.y.astype(int))
    else:
        model.bias = 4.0 if counts.get(1) else -4.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(kept)
        for batch in batches:
            logits = model.logits([np.array(found.of(t), dtype=np.int64) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(logits))], names=["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
