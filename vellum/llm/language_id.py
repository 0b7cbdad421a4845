"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. A text is read in windows
of WINDOW bytes, across words and white space; each window is read from both ends, every
byte position is labelled with a distribution over the languages, and a document's
distribution is the mean over all of its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, map_arrow
from vellum.llm.learning import held_out, sampled

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bounds of the training set: documents of a language (one at least), and about so many of all. Their texts are taken whole.
DOCS_PER_LANGUAGE, DOCS = 300, 3000
HIDDEN, STEPS, BATCH, RATE = 16, 500, 256, 0.02
#: Bytes of a window; windows run through the network at once, and probabilities held at once.
WINDOW, CHUNK, CELLS = 64, 1024, 1 << 22
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes) -> list[bytes]:
    """The whole text in pieces of WINDOW bytes."""
    return [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by (position, window), zero behind the end, and the lengths."""
    n = np.array([len(w) for w in windows])
    width = int(n.max(initial=1))
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(len(windows), width).T), n


class Cell:
    """A gated recurrent unit over bytes: h' = (1 - z) * n + z * h."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        f = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        self.hidden, self.wx, self.u, self.b = hidden, f(256, 3 * hidden), f(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.b]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States by (position, window, unit); zero where the mask is. keep: gets what back() needs."""
        k, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        out, a, c = np.empty((*x.shape, k), np.float32), *(np.empty((x.shape[1], 3 * k), np.float32) for _ in range(2))
        # The logistic of v is half of 1 + tanh(v / 2): the halves go into the weights.
        half = np.repeat(np.array([0.5, 1.0], np.float32), [2 * k, k])
        wx, u = (self.wx + self.b) * half, self.u * half
        whole = mask.all(axis=1)
        for t in range(len(x)):
            np.take(wx, x[t], axis=0, out=a)
            np.matmul(h, u, out=c)
            zr = a[:, : 2 * k] + c[:, : 2 * k]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            n = c[:, 2 * k :] * zr[:, k:]
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, zr[:, :k], zr[:, k:], n, c[:, 2 * k :].copy()))
            new = h - n
            new *= zr[:, :k]
            new += n
            if not whole[t]:
                new *= mask[t][:, None]
            out[t] = h = new
        return out

    def back(self, x: np.ndarray, mask: np.ndarray, keep: list, up: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, given those of the states: backpropagation through time."""
        k = self.hidden
        g_wx, g_u, g_b = (np.zeros_like(p) for p in self.params())
        letters = np.eye(256, dtype=np.float32)
        down = np.zeros_like(up[0])
        for t in reversed(range(len(x))):
            h, z, r, n, c = keep[t]
            d = (up[t] + down) * mask[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            into = np.concatenate([dz, dr, dn], axis=1)
            through = np.concatenate([dz, dr, dn * r], axis=1)
            g_wx += letters[x[t]].T @ into
            g_b += into.sum(axis=0)
            g_u += h.T @ through
            down = d * z + through @ self.u.T
        return [g_wx, g_u, g_b]


class ByteTagger:
    """Two cells, one from each end, and a softmax over the languages at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Cell(rng, hidden), Cell(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.forward.params(), *self.backward.params(), self.out, self.bias]

    def states(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        ahead = self.forward.run(x, mask, keep and keep[0])
        behind = self.backward.run(x[::-1], mask[::-1], keep and keep[1])[::-1]
        return np.concatenate([ahead, behind], axis=2)

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities by (position, window, language)."""
        k = self.forward.hidden
        logits = self.forward.run(x, mask) @ self.out[:k]
        logits += (self.backward.run(x[::-1], mask[::-1]) @ self.out[k:])[::-1]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def at_once(self) -> int:
        """Windows run at once: fewer where there are many languages."""
        return max(1, min(CHUNK, CELLS // (WINDOW * max(1, len(self.languages)))))

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution over all positions of each text; zero for an empty one."""
        windows = [w for t in texts for w in windows_of(t)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
        out = np.zeros((len(texts), len(self.languages)))
        order, step = np.argsort([len(w) for w in windows], kind="stable"), self.at_once()
        for i in range(0, len(order), step):
            part = order[i : i + step]
            x, n = padded([windows[j] for j in part])
            mask = (np.arange(len(x))[:, None] < n).astype(np.float32)
            p = self.positions(x, mask)
            p *= mask[:, :, None]
            np.add.at(out, owner[part], p.sum(axis=0))
        return out / np.maximum(1, [len(t) for t in texts])[:, None]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions."""
        keep: tuple[list, list] = ([], [])
        states = self.states(x, mask, keep)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p *= (mask / mask.sum())[:, :, None]
        up, k = p @ self.out.T, self.forward.hidden
        first = self.forward.back(x, mask, keep[0], up[:, :, :k])
        second = self.backward.back(x[::-1], mask[::-1], keep[1], up[::-1, :, k:])
        return [*first, *second, np.einsum("tnk,tnl->kl", states, p), p.sum(axis=(0, 1))]

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adam over batches of windows that start anywhere in the texts; languages, then their texts by length, are drawn alike."""
        rng = np.random.default_rng(seed)
        sizes = np.array([len(t) for t in texts])
        by = [np.flatnonzero((y == k) & (sizes > 0)) for k in range(len(self.languages))]
        by = [(b, np.cumsum(sizes[b])) for b in by if len(b)]
        if not by:
            return
        m1, m2 = ([np.zeros_like(p) for p in self.params()] for _ in range(2))
        for step in range(1, steps + 1):
            pick, windows = [], []
            for k in np.arange(BATCH) % len(by) if len(by) <= BATCH else rng.integers(0, len(by), BATCH):
                b, ends = by[k]
                at = int(rng.integers(0, ends[-1]))
                i = int(np.searchsorted(ends, at, side="right"))
                start = max(0, min(at - (int(ends[i - 1]) if i else 0), int(sizes[b[i]]) - WINDOW))
                pick.append(b[i])
                windows.append(texts[b[i]][start : start + WINDOW])
            x, n = padded(windows)
            mask = (np.arange(len(x))[:, None] < n).astype(np.float32)
            rate = RATE * (1 - 0.9 * step / steps)
            grads, some = [np.zeros_like(p) for p in self.params()], self.at_once()
            for i in range(0, len(pick), some):
                part = slice(i, i + some)
                for total, g in zip(grads, self.gradients(x[:, part], mask[:, part], y[pick[part]]), strict=True):
                    total += g * (mask[:, part].sum() / mask.sum())
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for p, g, a, b in zip(self.params(), grads, m1, m2, strict=True):
                g = g / norm
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)


def training_texts(docs: DataFrame, folds: int, which: int) -> DataFrame:
    """lang, text of a bounded sample (by hash of id and text), the same number for each language. docs: doc_id, lang, _text."""
    open_ = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND _text IS NOT NULL").filter(~held_out(F.col("doc_id"), folds, which))
    n = open_.select("lang").distinct().count()
    per = max(1, min(DOCS_PER_LANGUAGE, DOCS // max(1, n)))
    return sampled(open_, "lang", per, F.xxhash64(F.lit(7), "doc_id", "_text")).select("doc_id", "lang", F.col("_text").cast("binary").alias("text"))


def language_id(docs: DataFrame, text: str = "text", folds: int = FOLDS, which: int = HELD_OUT, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, from the whole text alone.

    score is the pooled probability of lang_pred.

    * a text that is null or has no letter: 'und', score 0; so is every text when no
      language can be learnt.
    * null lang or null doc_id: never learnt from, but predicted (held_out false for a null id).
    * repeated rows: predicted alike, learnt from once. Ties go to the language first by code point.
    * very long texts are read whole, one at a time.
    * however many languages there are, each has at least one document in the sample.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "lang", F.col(text).alias("_text"))
    got = cut(training_texts(docs, folds, which)).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    model = ByteTagger(sorted(set(got["lang"].to_pylist())))
    if len(model.languages) > 1:
        model.fit(got["text"].to_pylist(), np.searchsorted(model.languages, got["lang"].to_pylist()), steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and model.languages and _LETTER.search(t.decode("utf-8", "replace")) else None for t in batch.column(1).to_pylist()]
            pooled = model.pooled([t or b"" for t in texts])
            best = [(UNKNOWN, 0.0) if t is None else (model.languages[int(p.argmax())], min(1.0, float(p.max()))) for t, p in zip(texts, pooled, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_text").cast("binary").alias("_text")), run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), "lang_pred", "score")
