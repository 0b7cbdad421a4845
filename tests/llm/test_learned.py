import random
import zlib

import numpy as np
import pytest

from vellum.llm.language_id import WINDOW, ByteTagger, Cell, language_id, padded
from vellum.llm.learning import sampled, taught_whole
from vellum.llm.quality import FEATURES, SHARES, Featurer, PairRanker, Rivals, blocks_of, histogram, quality_filter, quality_scores, totals
from vellum.llm.toxicity import FactorizationMachine, toxicity_scores


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


LABELS = "doc_id long, quality int, toxic int, score double"


def numeric(f, p, i, eps=1e-2):
    keep = p[i]
    p[i] = keep + eps
    up = f()
    p[i] = keep - eps
    down = f()
    p[i] = keep
    return (up - down) / (2 * eps)


def test_backpropagation_through_time():
    m = ByteTagger(["a", "b", "c"], hidden=5, seed=1)
    x, n = padded([b"abcd", b"xy", b"q"])
    mask = (np.arange(len(x))[:, None] < n).astype(np.float32)
    y = np.array([0, 2, 1])

    def loss():
        p = m.positions(x, mask)
        return float(-(np.log(p[:, np.arange(3), y]) * mask).sum() / mask.sum())

    for p, g in zip(m.params(), m.gradients(x, mask, y), strict=True):
        for i in [tuple(np.unravel_index(int(np.abs(g).argmax()), g.shape)), (0,) * g.ndim]:
            assert abs(numeric(loss, p, i) - g[i]) < 2e-3


def test_states_reset_behind_the_end():
    rng = np.random.default_rng(0)
    c = Cell(rng, 4)
    one, n = padded([b"ab"])
    two, k = padded([b"ab", b"abcdef"])
    mask = lambda x, n: (np.arange(len(x))[:, None] < n).astype(np.float32)
    assert np.allclose(c.run(one, mask(one, n))[:, 0], c.run(two, mask(two, k))[:2, 0]) and not c.run(two, mask(two, k))[2:, 0].any()


def test_pooling_equals_plain_loops():
    """The network unit by unit and byte by byte, in double precision, windows of whole texts across words."""
    m = ByteTagger(["a", "b", "c"], hidden=4)
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def states(cell, data):
        k, h, out = cell.hidden, np.zeros(cell.hidden), []
        wx, u, b = (np.asarray(p, np.float64) for p in cell.params())
        for byte in data:
            c, new = [sum(h[i] * u[i, j] for i in range(k)) for j in range(3 * k)], []
            for j in range(k):
                z, r = logistic(wx[byte, j] + b[j] + c[j]), logistic(wx[byte, k + j] + b[k + j] + c[k + j])
                n = np.tanh(wx[byte, 2 * k + j] + b[2 * k + j] + r * c[2 * k + j])
                new.append((1 - z) * n + z * h[j])
            h = np.array(new)
            out.append(h)
        return out

    def brute(text):
        total = np.zeros(3)
        for i in range(0, len(text), WINDOW):
            w = text[i : i + WINDOW]
            for x, y in zip(states(m.forward, w), states(m.backward, w[::-1])[::-1], strict=True):
                e = np.exp(np.concatenate([x, y]) @ m.out.astype(np.float64) + m.bias)
                total += e / e.sum()
        return total / max(1, len(text))

    texts = [b"one two three. " * 9, b"", "Gr\u00fc\u00dfe \u4e2d\u6587".encode(), b"x"]
    assert np.allclose(m.pooled(texts), [brute(t) for t in texts], atol=1e-4)
    few = ByteTagger([f"l{i:04d}" for i in range(70_000)], hidden=2)
    assert few.at_once() == 1 and few.pooled([b"ab cd"]).shape == (1, 70_000)


def test_windows_cross_words():
    """What stands before a space changes the labels after it."""
    m = ByteTagger(["a", "b"], hidden=4)
    label = lambda t: m.positions(*(lambda x, n: (x, np.ones(x.shape, np.float32)))(*padded([t])))[-1, 0]
    assert not np.allclose(label(b"xyz q"), label(b"abc q"))


def test_thousands_of_languages(spark, docs):
    """More languages than documents in the sample: none is left out, nothing becomes 'und'."""
    df = docs(*[(i, f"words of {i}", f"l{i % 3100:04d}") for i in range(6200)])
    got = language_id(df, steps=2)
    assert got.filter("lang_pred = 'und'").count() == 0 and got.count() == 6200


def test_a_repeated_id_stays_within_the_bound(spark, docs):
    """One id on 100,000 rows, equal and different, and a class of one row."""
    from pyspark.sql import functions as F

    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") < 50_000, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    rows = hot.unionByName(spark.createDataFrame([(2, "ein Text", "de")], "doc_id long, text string, lang string"))
    got = {r.lang: (r.n, r.d) for r in sampled(rows, "lang", 50, F.xxhash64("doc_id", "text")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("d")).collect()}
    assert got == {"en": (50, 50), "de": (1, 1)}
    labels = spark.createDataFrame([(i, i % 2, i % 2, 0.0) for i in range(1, 9)], LABELS)
    for f in (quality_scores, toxicity_scores):
        assert f(hot.select("doc_id", "text"), labels).select("score").distinct().count() >= 1


STEMS = {"en": ("th", "ing", "wh"), "de": ("sch", "ung", "ß"), "fr": ("eau", "é", "oui")}


def test_language_id_learns(docs, odd):
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        lang = list(STEMS)[i % 3]
        rows.append((i, " ".join("".join(rnd.choices(STEMS[lang], k=3)) for _ in range(rnd.randint(2, 30))), lang))
    df = docs(*rows, (900, None, "en"), (901, "12 !?", "en"), (902, "", "de"))
    out = {r.doc_id: r for r in language_id(df).collect()}
    assert all(out[i].held_out == (fold(i, 4) == 2) for i in out)
    assert sum(out[i].lang_pred == lang for i, _, lang in rows if out[i].held_out) >= 0.97 * sum(out[i].held_out for i, _, _ in rows)
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert language_id(odd).count() == odd.count() and language_id(odd.filter("false")).count() == 0
    assert {r.lang_pred for r in language_id(docs((0, "abc", None))).collect()} == {"und"}


def quality_rows(n, seed=9):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 120))]
        bad = i % 5 == 0
        kind = i // 5 % 3
        if bad:
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:12] for _ in range(9)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad), 0.0))
    return rows, labels


def test_quality_learns_and_filters(spark, docs, odd):
    rows, labels = quality_rows(400)
    df, lab = docs(*rows), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in quality_scores(df, lab).collect()}
    assert all(out[i].held_out == (fold(i, 5) == 0) and out[i].predicted == (out[i].score >= 0.3) and 0 <= out[i].score <= 1 for i in out)
    assert all(out[i].predicted == q for i, q, _, _ in labels)
    kept = quality_filter(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, q, _, _ in labels if q}
    assert quality_scores(odd, lab).count() == odd.count() and quality_scores(odd.filter("false"), lab).count() == 0


@pytest.mark.parametrize(("kinds", "predicted"), [((), 1), ((1,), 1), ((0,), 0)])
def test_quality_without_both_labels(spark, docs, kinds, predicted):
    lab = spark.createDataFrame([(i, k, 0, 0.0) for i, k in enumerate(kinds * 10)], LABELS)
    assert {r.predicted for r in quality_scores(docs(*["some text"] * 10), lab).collect()} == {predicted}


def test_labels_of_the_held_out_fold_do_not_matter(spark, docs):
    rows, labels = quality_rows(200)
    df = docs(*rows)
    flipped = [(i, 1 - q if fold(i, 5) == 0 else q, t, s) for i, q, t, s in labels] + [(3, None, None, 0.0), (1, 7, 7, 0.0)]
    score = lambda lab, f: {r.doc_id: r.score for r in f(df, spark.createDataFrame(lab, LABELS)).collect()}
    assert score(labels, quality_scores) == score(flipped, quality_scores)
    tox = [(i, q, 1 - t if fold(i, 5) == 0 else t, s) for i, q, t, s in labels]
    assert score(labels, toxicity_scores) == pytest.approx(score(tox, toxicity_scores), abs=1e-9)


def test_features_are_finite():
    x = Featurer().of([None, b"", b" ", b"A", b"!!!", b"a " * 1000, "中".encode() * 50])
    assert x.shape == (7, FEATURES) and np.isfinite(x).all() and (x <= 1).all()


def test_pairwise_loss_equals_plain_loops():
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=(12, 5)), PairRanker(np.zeros((0, 5)), np.zeros(0), 0.0)
    m.weights = rng.normal(size=5)
    first, second = rng.integers(0, 6, 20), rng.integers(6, 12, 20)

    def loss(w):
        pairs = [np.log1p(np.exp(-sum(w[k] * (x[i, k] - x[j, k]) for k in range(5)))) for i, j in zip(first, second, strict=True)]
        return sum(pairs) / 20 + 5e-4 * sum(v * v for v in w)

    slope, value = m.pair_loss(x, first, second)
    near = [(loss(m.weights + d) - loss(m.weights - d)) / 2e-5 for d in np.eye(5) * 1e-5]
    assert abs(value - loss(m.weights)) < 1e-9 and np.allclose(slope, near, atol=1e-6)


def test_quality_by_words_alone(spark, docs):
    """Only a word tells good from bad: no share of bytes does."""
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(30)]
        words[rnd.randrange(30)] = "klomp" if i % 3 == 0 else "wedge"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), 0, 0.0))
    out = {r.doc_id: r for r in quality_scores(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, q) for i, q, _, _ in labels if out[i].held_out]
    assert sum(out[i].predicted == q for i, q in held) >= 0.9 * len(held)


def test_ranker_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(SHARES)))
    y = (x[:, 2] < 1).astype(int)
    m = PairRanker(x, y, float((y == 0).mean()))
    assert ((m.scores(x) >= 0.3) == y).mean() > 0.97


def test_quality_learns_from_every_labelled_id(spark, docs):
    """A word that only ids beyond the 10,000 of each class with the least hashes hold still counts."""
    from pyspark.sql import functions as F

    ids = spark.range(27_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y")).filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    some = {r.doc_id for r in sampled(ids, "y", 10_000, F.xxhash64(F.lit(9), "doc_id")).collect()}
    rest = [r.doc_id for r in ids.collect() if r.doc_id not in some]
    assert len(some) == 20_000 and len(rest) > 500
    word = dict.fromkeys(rest, ("klomp", "wedge"))
    rows = [(i, f"{word[i][i % 2]} and so on" if i in word else "plain and so on") for i in range(27_000)] + [(30_000, "klomp and so on"), (30_001, "wedge and so on")]
    labels = spark.createDataFrame([(i, i % 2, 0, 0.0) for i in range(27_000)], LABELS)
    out = {r.doc_id: r.score for r in quality_scores(docs(*rows), labels).filter("doc_id >= 30000").collect()}
    assert out[30_000] < 0.3 < out[30_001]


def test_slope_and_curvature_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 6)).astype(np.float32), rng.integers(0, 2, 90)
    x[y == 1, 1] += 1
    m, over = PairRanker(x, y), lambda f: f(x, y == 1)
    first, second = (v.ravel() for v in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    z = (x - m.centre) / m.spread
    assert np.abs(m.pair_loss(z, first, second)[0]).max() < 1e-3  # learnt to the end
    m.weights = rng.normal(size=6)
    plain, value = m.pair_loss(z, first, second)
    rivals = Rivals(histogram(m.strength(x), y == 1))
    slope, curve = m.newton(over, rivals)
    assert abs(rivals.loss() + m.ridge(m.weights) - value) < 1e-4 and np.allclose(slope, plain, atol=1e-4)
    d = z[first] - z[second]
    p = 1 / (1 + np.exp(-d @ m.weights))
    assert np.allclose(curve, (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(6), atol=2e-3)


def test_blocks_give_what_one_block_gives(spark, docs):
    """Several partitions, one of them empty; null texts; an id with two texts, one with both labels and one without a row."""
    rows, labels = quality_rows(300)
    df = docs(*rows, (1, "another text"), (700, None), (701, "x"), (None, "y"))
    lab = spark.createDataFrame([*labels, (700, 1, 0, 0.0), (701, 1, 0, 0.0), (701, 0, 0, 0.0), (999, 0, 0, 0.0)], LABELS)
    met = taught_whole(df, "text", lab, "quality", 5, 0)
    got = {r.doc_id: (r.y, r._text) for r in met.collect()}
    assert set(got) == {i for i in [*range(300), 700] if fold(i, 5)} and got[1][1] in (rows[1][1], "another text") and met.count() == len(got)
    y, texts = zip(*got.values(), strict=True)
    one = PairRanker(Featurer().of([t and t.encode() for t in texts]).astype("<f2"), np.array(y))
    blocks = blocks_of(met.repartition(5, "doc_id").filter("doc_id is not null")).cache()
    m = PairRanker.of(blocks)
    x = Featurer().of([r[1].encode() for r in rows])
    assert np.allclose(m.scores(x), one.scores(x), atol=1e-6) and np.abs(m.weights).max() > 0
    assert totals(blocks, lambda x, good: (np.array([len(x), good.sum()]), np.empty(0), np.empty(0)))[0].tolist() == [len(y), sum(y)]


@pytest.mark.parametrize("values", [[0.0] * 9, [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0], [1e-9 * k for k in range(9)], [500.0 + 1e-6 * k for k in range(9)], [-1e6, -3.0, 0.1, 0.1, 0.1, 0.1, 0.2, 7.0, 1e300 ** 0.5]])
def test_the_cut_is_exact(values):
    s, m = np.array(values), PairRanker(np.zeros((0, 1)), np.zeros(0))
    m.strength = lambda x: x[:, 0].astype(np.float64)
    for below in range(1, 9):
        middle, deviation = m.cut(lambda f: f(s[::-1, None], np.ones(9, bool)), below)
        assert middle == (s[below - 1] + s[below]) / 2


def test_machine_learns_what_no_single_term_tells():
    """Toxic only where both terms occur: weights alone can't separate it with an equal mix of the single terms."""
    rows, y = [], []
    for i in range(200):
        a, b = i % 2, i // 2 % 2
        rows.append(np.array(([0] if a else []) + ([1] if b else [])))
        y.append(int(a == b))
    m = FactorizationMachine(2)
    m.fit(rows, np.array(y))
    assert (((m.logits(rows) > 0).astype(int)) == np.array(y)).all()


def test_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = FactorizationMachine(9)
    m.bias, m.w, m.v = 0.3, rng.normal(size=9), rng.normal(size=(9, 8))
    rows = [np.array(r) for r in ([0, 3, 5, 8], [2], [1, 2, 3])] + [np.empty(0, np.int64)]
    want = [m.bias + sum(m.w[i] for i in r) + sum(sum(m.v[i, k] * m.v[j, k] for k in range(8)) for i in r for j in r if i < j) for r in rows]
    assert np.allclose(m.logits(rows), want)


@pytest.mark.parametrize("fill", [(5, 30), (40, 120)])
def test_toxicity_of_both_or_neither(spark, docs, fill):
    """Toxic where both of two common words stand, or neither: no class difference of either alone."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1000):
        a, b = i % 2, i // 2 % 2
        words = [*(rnd.choice(vocabulary) for _ in range(rnd.randint(*fill))), *["kettle"] * a, *["garden"] * b]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a == b), 0.0))
    out = {r.doc_id: r for r in toxicity_scores(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, bad) for i, _, bad, _ in labels if out[i].held_out]
    assert sum(out[i].predicted == bad for i, bad in held) >= 0.95 * len(held)


def test_toxicity_learns_stems(spark, docs, odd):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(500):
        words, bad = [word() for _ in range(rnd.randint(5, 80))], i % 6 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["ZORKEN", "zorkish,", "vrunt", "Vruntling"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), 0.0))
    df, lab = docs(*rows, (900, None), (901, "")), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in toxicity_scores(df, lab).collect()}
    assert all(out[i].predicted == t for i, _, t, _ in labels) and out[900].predicted == out[901].predicted == 0
    assert all(out[i].predicted == (out[i].score >= 0.5) and 0 <= out[i].score <= 1 for i in out)
    assert toxicity_scores(odd, lab).count() == odd.count() and toxicity_scores(odd.filter("false"), lab).count() == 0
    assert {r.predicted for r in toxicity_scores(df, lab.filter("false")).collect()} == {0}


def test_toxicity_of_pairs_only(spark, docs):
    """Every term is as common in clean as in toxic documents: only pairs tell."""
    rnd = random.Random(8)
    filler = lambda: ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 8))) for _ in range(rnd.randint(5, 30))]
    rows, labels = [], []
    for i in range(1200):
        bad, a = i % 2, i // 2 % 3
        words = [*filler(), ("zorken", "vrunt", "plimo")[a], ("quist", "jomble", "wexyn")[a if bad else (a + 1 + i // 6 % 2) % 3]]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, bad, 0.0))
    out = {r.doc_id: r for r in toxicity_scores(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, bad) for i, _, bad, _ in labels if out[i].held_out]
    assert sum(out[i].predicted == bad for i, bad in held) >= 0.97 * len(held)


def test_toxicity_falls_back_to_the_prior(spark, docs):
    rows = [(i, f"text {'abcdefgh'[i % 8]}") for i in range(16)]
    labels = [(i, 1, int(i in (1, 2, 3)), 0.0) for i, _ in rows]
    got = toxicity_scores(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.predicted for r in got} == {0} and max(r.score for r in got) < 0.4
