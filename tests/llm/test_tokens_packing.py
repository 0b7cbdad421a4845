import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.packing import Complements, pack, piece_bounds, plan_once, plan_sequences
from vellum.llm.tokens import TOKENIZER, Encoder, length_histogram, quantile_lengths, token_lengths, totals_at

FULL = Tokenizer.from_file(TOKENIZER)


def ids(text):
    return FULL.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_the_tokenizers_ids(text):
    e = test_fast_ids_are_the_tokenizers_ids.__dict__.setdefault("e", Encoder(TOKENIZER))
    assert e.ids(text).tolist() == ids(text)


def test_special_strings_and_long_words():
    e = Encoder(TOKENIZER)
    for t in ("a<|endoftext|>b", "<|endoftext|>", "x" * 5000, " \n\n\t  a", "中文🙂" * 50):
        assert e.ids(t).tolist() == ids(t)


def test_histogram_answers_all_limits(odd, spark):
    rows = token_lengths(odd)
    lengths = [r.n_tokens for r in rows.collect()]
    assert sorted(lengths) == sorted(len(ids(r.text)) for r in odd.collect())
    hist = length_histogram(rows)
    got = {r.length: r for r in hist.collect()}
    for x, n in Counter(lengths).items():
        r = got[x]
        cut = sum(min(v, x) for v in lengths)
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.docs_total, r.tokens_total) == (n, sum(v > x for v in lengths), sum(v for v in lengths if v > x), len(lengths), sum(lengths))
        assert (r.truncated_tokens, r.cut_tokens) == (cut, sum(lengths) - cut) and abs(r.cdf - sum(v <= x for v in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 5, 7, 100, 10**6]
    assert {r.limit: (r.docs_over, r.truncated_tokens) for r in totals_at(hist, limits).collect()} == {x: (sum(v > x for v in lengths), sum(min(v, x) for v in lengths)) for x in limits}
    assert {r.share: r.length for r in quantile_lengths(hist, [0.0, 0.5, 1.0]).collect()} == {s: min(x for x in lengths if sum(v <= x for v in lengths) >= s * len(lengths)) for s in (0.0, 0.5, 1.0)}


def test_histogram_of_nothing(docs):
    empty = length_histogram(token_lengths(docs("a").filter("false")))
    assert empty.count() == 0
    assert [tuple(r) for r in totals_at(empty, [10]).collect()] == [(10, 0, 0)]


def check_packed(df, out, capacity=1024):
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        x = np.array([*ids(r.text), 2], dtype="<u4")
        for k, (s, n) in enumerate(piece_bounds(len(x), capacity)):
            want[(r.doc_id, k, s, n, zlib.crc32(x[s : s + n].tobytes()))] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_odd_rows(odd):
    check_packed(odd, pack(odd, TOKENIZER))


def test_pack_small_capacity_and_empty(docs):
    df = docs(*[" ".join(["word"] * (i % 23)) for i in range(150)])
    n = check_packed(df, pack(df, TOKENIZER, capacity=16), 16)
    assert n <= -(-sum(i % 23 + 1 for i in range(150)) // 16) + 3
    assert pack(df.filter("false"), TOKENIZER).count() == 0


def test_piece_bounds():
    assert piece_bounds(1024, 1024) == [(0, 1024)] and piece_bounds(1025, 1024) == [(0, 1), (1, 1024)] and piece_bounds(2048, 1024) == [(0, 1024), (1024, 1024)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plan_uses_every_piece_once(counts):
    plan = plan_sequences(counts, 64)
    used = Counter()
    for lengths, times, closing in plan:
        assert times > 0 and sum(lengths) <= 64 and (not closing or sum(lengths) == 64 and closing < len(lengths))
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t, _ in plan) <= max(1, -(-total // 64)) * 3 // 2 + sum(n for x, n in counts.items() if x > 32)


def index(capacity=100, **counts):
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in counts.items():
        left[int(k[1:])] = n
    return Complements(left)


def test_complement_prefers_one_then_two_then_three():
    c = index(_40=1, _25=1, _10=1, _5=1)
    assert c.of(40) == (40,) and c.of(35) == (25, 10) and c.of(70) == (40, 25, 5) and c.of(20) is None and c.of(80) is None
    c = index(_40=1, _25=1, _10=3, _5=1)
    assert c.of(20) == (10, 10) and c.of(30) == (25, 5)
    c = index(_20=1, _18=1, _12=2, _10=1, _2=1)
    assert c.of(30) == (20, 10) and c.of(30, longest=True) == (20, 10) and index(_20=1, _18=1, _12=1, _6=1, _4=1).of(30, longest=True) == (20, 6, 4)


def brute_sums(left, gap):
    have = [x for x in range(1, len(left)) for _ in range(min(3, int(left[x])))]
    return gap in have or any(have[i] + have[j] + (have[k] if k is not None else 0) == gap for i in range(len(have)) for j in range(i) for k in [None, *range(j)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(1, 3)), max_size=6))
def test_the_index_has_every_sum_and_follows_the_counts(counts, taken):
    c = index(40, **{f"_{k}": n for k, n in counts.items()})
    for i, times in taken:
        x = sorted(counts)[i % len(counts)]
        if c.left[x] >= times:
            c.take((x,), times)
    for gap in range(1, 41):
        for longest in (False, True):
            got = c.of(gap, longest)
            assert (got is not None) == brute_sums(c.left, gap)
            assert got is None or sum(got) == gap and all(c.left[x] >= got.count(x) for x in got) and list(got) == sorted(got, reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=12))
def test_what_can_be_filled_exactly_is(counts):
    """Without slack: no sequence that a single, pair or triple of what is left over at its end could have closed stays open."""
    left = np.zeros(65, dtype=np.int64)
    for lengths, times, closing in reversed(plan_once(counts, 64)):
        gap = 64 - sum(lengths)
        if gap:
            assert not closing and Complements(left.copy()).of(gap) is None
        for x in lengths:
            left[x] += times


def plain_best_fit(counts, capacity):
    """Best fit decreasing, one piece at a time."""
    open_ = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, gap in enumerate(open_) if gap >= x]
        if fits:
            open_[min(fits, key=lambda i: open_[i])] -= x
        else:
            open_.append(capacity - x)
    return len(open_)


def test_hardly_ever_more_sequences_than_plain_best_fit():
    rnd = random.Random(9)
    more = fewer = 0
    for _ in range(60):
        counts = {rnd.randint(1, rnd.choice([60, 300, 700, 1024])): rnd.randint(1, 6) for _ in range(rnd.choice([5, 20, 60]))}
        n, plain = sum(t for _, t, _ in plan_sequences(counts)), plain_best_fit(counts, 1024)
        more, fewer = more + (n > plain), fewer + (n < plain)
    assert more <= 1 and fewer >= 5, (more, fewer)


def lower_bound(counts, capacity):
    """Of Martello and Toth: long pieces need a sequence each, short ones what these leave open, or more."""
    best = 0
    for a in range(capacity // 2 + 1):
        full = sum(n for x, n in counts.items() if x > capacity - a)
        half = {x: n for x, n in counts.items() if capacity // 2 < x <= capacity - a}
        open_ = sum((capacity - x) * n for x, n in half.items())
        short = sum(x * n for x, n in counts.items() if a <= x <= capacity // 2)
        best = max(best, full + sum(half.values()) + max(0, -(-(short - open_) // capacity)))
    return best


def test_many_equal_lengths_need_few_plan_entries():
    rnd = random.Random(4)
    counts = {rnd.randint(1, 1024): rnd.randint(1, 10**9) for _ in range(900)}
    plan = plan_sequences(counts)
    assert len(plan) < 4096 and sum(t for _, t, _ in plan) < 1.01 * lower_bound(counts, 1024) + 1


def test_packing_survives_tiny_pieces(docs, spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert pack(df, TOKENIZER).select("sequence_id").distinct().count() == 3
