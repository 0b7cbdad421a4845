import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm.exact_dedup import chunks, exact_dedup
from vellum.llm import near_dedup as N
from vellum.llm.common import join_groups
from vellum.llm.near_dedup import Shingles, components, leftovers, near_dedup, prefix_length, settled, sketches

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(UP)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(UP)
        keep = max((x for x in by[norm] if x is not None), default=None)
        out.append((i, keep, len(by[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def same_exact(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in exact_dedup(df, **kw).collect()], key=str) == brute_exact(rows)


def test_exact_odd_rows(odd):
    same_exact(odd)


def test_exact_empty_table(docs):
    assert exact_dedup(docs((1, "a")).filter("false")).count() == 0


def test_exact_with_clashing_identifiers(docs):
    """Identifiers of so few bits clash; they must be found out and made longer."""
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("abdgk \n") for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(200 + i, t.upper()) for i, t in rows[:60]]
    same_exact(docs(*rows), words=1, bits=6, least=5, most=12)


def test_only_ascii_is_lowered(docs):
    same_exact(docs("ÄA", "äa", "Äa", "İ", "i̇", "K", "k"))


def test_exact_hot_group(docs):
    same_exact(docs(*[(i, "hot" if i % 3 else f"t{i}") for i in range(400)]))


def test_chunks_are_lossless(spark):
    df = spark.createDataFrame([("x" * 10_000,), ("a\U0001f600\n" * 3000,), ("",), ("\U00020000\u4e00" * 4000,), ("".join(map(chr, range(0x400, 0x2400))),)], "t string")
    got = df.select("t", chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(0 < len(c) <= 4096 for c in r.c) for r in got)


#: First letter and number of letters of some scripts; whether words stand apart.
SCRIPTS = {"latin": (0x61, 26, True), "cyrillic": (0x430, 32, True), "greek": (0x3B1, 25, True), "arabic": (0x627, 36, True), "hindi": (0x915, 37, True), "thai": (0xE01, 46, False), "korean": (0xAC00, 900, True), "chinese": (0x4E00, 1500, False)}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_shift_with_content(spark, script):
    """After a prefix all but the first chunks come back, in any script."""
    first, n, spaced = SCRIPTS[script]
    rnd = random.Random(script)
    letters = [chr(first + i) for i in range(n)]
    weights = [1 / (i + 2) for i in range(n)]  # some letters are common, as in any language
    words = ["".join(rnd.choices(letters, weights, k=rnd.randint(1, 3 if n > 100 else 9))) for _ in range(1500)]
    text = (" " if spaced else "").join(rnd.choice(words) for _ in range(12_000))
    a, b = (set(r.c) for r in spark.createDataFrame([(text,), (letters[0] * 7 + text,)], "t string").select(chunks(F.col("t")).alias("c")).collect())
    assert len(a & b) >= len(a) - 2 and len(a) >= 10


def brute_near(rows, k, percent=80):
    def shingles(t):
        w = (t or "").translate(UP).encode().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            inter = len(a & b)
            if inter and rows[i][0] is not None and rows[j][0] is not None and 100 * inter >= percent * (len(a) + len(b) - inter):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(sets[i]), least[root(i)] if d is not None else None, d is None or d == least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def same_near(df, k):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in near_dedup(df, words=k).collect()], key=str) == brute_near(rows, k)


def test_near_odd_rows(odd):
    same_near(odd, 4)


def test_near_empty_table(docs):
    assert near_dedup(docs((1, "a")).filter("false")).count() == 0


def test_near_chains_hubs_and_copies(docs):
    """A chain whose ends are not alike, a hub of many edited copies, exact copies, and texts just below the threshold."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, n = [], 0
    for step in range(12):
        for _ in range(2):
            rows.append((n, " ".join(base)))
            n += 1
        base = base[:]
        base[step * 9] = word()
    hub = [word() for _ in range(60)]
    for _ in range(60):
        edited = hub[:]
        for _ in range(rnd.randint(0, 3)):
            edited[rnd.randrange(60)] = word()
        rows.append((n, " ".join(edited)))
        n += 1
    for share in range(1, 20):
        rows.append((n, " ".join(hub[: 60 - share] + [word() for _ in range(share)])))
        n += 1
    rnd.shuffle(rows)
    same_near(docs(*rows), 4)


def test_sketches_fill_and_estimate():
    s = Shingles(3)
    a = s.of(" ".join(f"w{i}" for i in range(1000)).encode())
    b = s.of(" ".join(f"w{i}" for i in range(100, 1100)).encode())
    one, two, tiny = sketches([a, b, a[:1]], 252)
    assert (tiny < 2**64 - 1).all() and abs((one == two).mean() - 898 / 1098) < 0.1
    assert (sketches([a], 252)[0] == one).all()


def test_rows_that_share_an_id_have_components_of_their_own(docs):
    base = " ".join(f"w{i}" for i in range(60))
    df = docs((3, base), (7, base + " tail"), (7, " ".join(f"v{i}" for i in range(60))), (7, base + " tail"), (8, base.upper()), (2, " ".join(f"u{i}" for i in range(9))))
    same_near(df, 4)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(df, words=4).collect()) == [(2, 2, True), (3, 3, True), (7, 3, False), (7, 3, False), (7, 7, True), (8, 3, False)]


@pytest.mark.parametrize("part_edges", [2, 7, 1000])
def test_components(spark, part_edges):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(10, 40)] + [(5, 40), (1, 2), (100, 99), (100, 98), (2, 1), (7, 7)] + [(1000, 1000 + i) for i in range(1, 60)]
    edges += [(rnd.randint(2000, 2080), rnd.randint(2000, 2080)) for _ in range(60)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), part_edges).collect()}
    assert got == {i: root(i) for i in up}
    assert components(spark.createDataFrame([], "a long, b long"), part_edges).count() == 0


@pytest.mark.parametrize("slice_", [4, 128])
def test_leftovers_find_every_link_of_a_mixed_bucket(spark, monkeypatch, slice_):
    """Templated sets in one bucket, each a component of its own: links by brute force, with short and with long lists."""
    monkeypatch.setattr(N, "SLICE", slice_)
    rnd = random.Random(6)
    shared = list(range(1000, 1060))
    sets = [sorted({*rnd.sample(shared, rnd.randint(50, 60)), *(rnd.randrange(10**6) for _ in range(rnd.randint(0, 8)))}) for _ in range(60)] + [[7], [7, 8], list(range(5))]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    entries = spark.createDataFrame([(1, i) for i in range(len(sets))], "bucket long, node long")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, items array<long>")
    got = leftovers(entries, spark.createDataFrame([], "node long, label long"), held, 80).collect()
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in got} == want and 0 < len(want) < 60 * 59 / 2


def test_prefixes_are_long_enough():
    for n in range(1, 200):
        assert prefix_length(n, 80) == n - (80 * n + 99) // 100 + 1


def test_small_tables_take_few_tasks(spark):
    """However many partitions a session deals keys to: with 211 of them, a join of 300 rows had 211 tasks and more."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(300).selectExpr("if(id < 200, -1, id) AS k", "id")
        got = join_groups(rows, rows.groupBy("k").count(), "k", "count", 300)
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted(tuple(r) for r in got.select("id", "count").collect()) == [(i, 200 if i < 200 else 1) for i in range(300)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_settled(spark):
    of = lambda *edges: settled(spark.createDataFrame(list(edges), "a long, b long"))
    assert of() and of((2, 1), (3, 1), (5, 4))
    assert not of((2, 1), (3, 2)) and not of((3, 1), (3, 2))
