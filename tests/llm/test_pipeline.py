import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from vellum.llm.mixing import mix_sources

NAMES = ["op3_topk_search", "op4_license_scan", "op5_exact_dedup", "op10_near_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = entry.queries()[name](spark, small)
    cur = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(cur.fetchall())


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad texts, exact and near copies, nulls, repeated rows, and an extra column."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rnd.randint(20, 90))]
        bad = i % 6 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text), "x"))
        labels.append((i, int(not bad), 0))
    good = [r for r in rows if r[0] % 6]
    rows += [(400 + k, r[1].upper() if k % 40 == 1 else r[1], "en", "s1", r[4], "x") for k, r in enumerate(good[:30]) if k % 40 != 1]
    rows += [(500 + k, r[1] + " extra", "en", None, r[4], None) for k, r in enumerate(good[40:60])]
    rows += [rows[1], (None, good[70][1] + " end", None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_do_what_they_say(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, corpus)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert not [i for i in ids["quality"] if i is not None and i < 300 and i % 6 == 0] and None in ids["quality"]
    texts = [r.text.lower() for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text.lower() for r in seen["quality"].collect()}
    assert not any(500 <= (i or 0) < 520 for i in ids["near_dedup"]) and None in ids["near_dedup"] and set(ids["near_dedup"].values()) == {1}
    taken = {r.doc_id: r.taken / r["size"] for r in mix_sources(seen["near_dedup"]).collect()}
    assert all(int(t) <= ids["mix"].get(i, 0) <= -int(-t // 1) for i, t in taken.items()) and max(ids["mix"].values()) == 2
    packed = seen["pack"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.agg(F.max("n")).first()[0] <= 1024
    assert Counter(r.doc_id for r in seen["pack"].filter("piece = 0").collect()) == ids["mix"]


def test_run_gives_the_stages_result(spark, corpus):
    out = P.run(spark, corpus)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_corpus(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_a_repeated_id_does_not_take_another_text_along(docs):
    """Rows that share an id: one a near copy of a smaller id, one a text of its own; repeated rows."""
    base = [f"w{i}" for i in range(60)]
    near, own = " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(60))
    df = docs((1, " ".join(base)), (7, near), (7, own), (8, own + " end"), (9, "one alone"), (None, near))
    left = {(r.doc_id, r.text) for r in P.drop_near_copies(df.sparkSession, df, "").collect()}
    assert left == {(1, " ".join(base)), (7, own), (9, "one alone"), (None, near)}


CLASHES = ("row", "th", "n", "sha", "of_doc_id", "of_id", "copies", "id", "_id", "_own", "_sha", "_text", "col", "component", "kept", "key", "size", "a b", "x`y")


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_on_odd_rows(spark, docs, odd, corpus, name, stage):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; an empty table."""
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    near = " ".join(f"w{i * i % 977}" for i in range(29_990))
    df = base.unionByName(docs((20, near), (20, near + " tail"), (20, near), (9, "One two three four five six."), (None, None), (None, "no id here at all now")))
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = stage(spark, df, corpus)
    assert stage(spark, df.filter("false"), corpus).count() == 0
    if name == "pack":
        assert out.filter("piece = 0").count() == df.count()
        return
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[c] == f"own {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    ids = Counter(r.doc_id for r in rows)
    if name == "exact_dedup":
        assert Counter((r.text or "").lower() for r in rows) == Counter({(r.text or "").lower() for r in df.collect()})
        assert ids[9] == 1 and ids[4] == ids[1] == 0 and ids[3] == 1 and ids[2] == 0
    if name == "near_dedup":
        assert {k: ids[k] for k in (6, 20, 4, 9, 2, 3, 5, None)} == {6: 1, 20: 0, 4: 0, 9: 0, 2: 1, 3: 1, 5: 1, None: 3} and ids[1] == 1
    if name == "mix":
        assert not ids[2] and not ids[3] and not ids[5] and all(n <= 2 * df.filter(F.col("doc_id").eqNullSafe(F.lit(i))).count() for i, n in ids.items())


def test_near_stage_against_brute_force(spark, docs):
    """Components by plain loops over five-word shingles; one row of each stays, with the smallest id."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(50)]
        for _ in range(rnd.randint(1, 4)):
            edited = base[:]
            for _ in range(rnd.randint(0, 2)):
                edited[rnd.randrange(50)] = word()
            rows.append((rnd.randint(0, 60), " ".join(edited)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(46)} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = Counter(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))
    left = P.drop_near_copies(spark, docs(*rows), "").collect()
    assert Counter(r.doc_id for r in left) == want and {(r.doc_id, r.text) for r in left} <= set(rows)


def test_mix_takes_the_ratio_of_each_document(spark, docs):
    df = docs(*[(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", f"s{i % 4}") for i in range(300)])
    taken = {r.doc_id: r.taken / r["size"] for r in mix_sources(df).collect()}
    got = Counter(r.doc_id for r in P.mix(spark, df, "").collect())
    assert all(int(t) <= got[i] <= -int(-t // 1) for i, t in taken.items())
    words = {i: 1 + i * 7 % 90 for i in taken}
    assert abs(sum(got[i] * words[i] for i in taken) - sum(taken[i] * words[i] for i in taken)) < 0.15 * sum(words.values())


def test_the_operators_stay_when_the_pipeline_is_missing(tmp_path):
    """Without corpus_pipeline.py the ten queries are still there; without both, the engine's."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(P.__file__).parent
    shutil.copytree(root / "vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(sum(k.startswith('op') for k in q), 'pipeline' in q, len(q) > 50)"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).stdout.split()
    assert ask() == ["10", "False", "True"]
    shutil.rmtree(tmp_path / "vellum" / "llm")
    assert ask() == ["0", "False", "True"]
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    assert ask() == ["0", "False", "True"]
