import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm.license_scan import compile_template, license_scan, words_of
from vellum.llm.mixing import mix_sources, targets
from vellum.llm.topk_search import best_of, topk_search

VEC = "vec_id long, embedding array<float>, rank int"


def brute_topk(rows, is_query, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(good):
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (401, [1.0, None] * 4), (402, [math.nan] * 8), (None, [1.0] * 8), (403, [1.0] * 3), (404, [math.inf] * 8), (500, [2.0] * 3), (405, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC)
    out = topk_search(df, F.col("vec_id") % 20 == 0, 10, block_rows=5, shard_rows=11)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_topk(rows, lambda q: q % 20 == 0, 10)
    assert topk_search(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_topk_with_huge_values_and_few_candidates(spark):
    rows = [(0, [3e9, 1e9]), (1, [1e7, -2e8]), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    got = sorted(tuple(r) for r in topk_search(df, F.col("vec_id") == 2).collect())
    assert got == brute_topk(rows, lambda q: q == 2, 10)


def test_partial_selection_breaks_ties_by_place():
    assert sorted(best_of(np.array([5, 7, 5, 7, 5]), 3)) == [0, 1, 3] and len(best_of(np.array([1]), 3)) == 1


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_against_brute_force(docs, odd):
    texts = ["Released UNDER-the MIT_License. under the mit license", "apache license, version 2.0 cc-by-nc cc by nc", "under the mit licenses", "xunder the mit license", "ünder the mit license under  the\nmit\tlicense", None, "cc by cc by nc cc by nc"]
    df = docs(*[(100 + i, t) for i, t in enumerate(texts)]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for r in license_scan(df).join(df.select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan(odd).count() == odd.count() and license_scan(odd.filter("false")).count() == 0


def brute_accepts(markup, words):
    """Every way to read a template as a regular expression over words."""
    parts = []
    for t in re.findall(r"\{\{|\}\}|\[\[\d+\]\]|[^\s{}\[\]]+", markup):
        parts.append({"{{": "(?:", "}}": ")?"}.get(t) or (rf"(?:\w+ ){{0,{t[2:-2]}}}" if t.startswith("[[") else t + " "))
    return re.compile("".join(parts)).fullmatch("".join(w + " " for w in words)) is not None


@pytest.mark.parametrize("markup", ["a b {{c d}} e", "a [[2]] b", "a {{b}} {{c}} d", "{{a}} b [[1]] {{c}} d", "a {{b [[1]]}} c"])
def test_automaton_accepts_what_the_template_says(markup):
    import itertools

    a = compile_template("x", markup)
    for n in range(1, 6):
        for words in itertools.product("abcde", repeat=n):
            tokens = [w.encode() for w in words]
            want = max((k for k in range(1, n + 1) if brute_accepts(markup, words[:k])), default=-1)
            assert a.accepts(tokens, 0) == want, words


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice {} shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """Example is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_templates_find_whole_licences(docs):
    cases = [
        (MIT.format("", "THE"), "mit"), (MIT.format("(including the next paragraph)", "EXAMPLE INC OR ITS"), "mit"), (MIT.format("(or not)", "THE"), ""), (MIT.format("", "THE").replace("WITHOUT WARRANTY", "WITH WARRANTY"), ""), (MIT.split("THE SOFTWARE IS")[0], ""),
        (BSD.format(""), "bsd-2"), (BSD.format(NAMES), "bsd-3"), (BSD.format(NAMES).replace("disclaimer", "claim"), ""), (BSD.split("THIS SOFTWARE")[0], ""), (APACHE, "apache-2"), (GPL, "gpl-3"), (GPL.replace("version 3", "version 2"), "gpl-2"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Copyright (c) 2020 Example Inc. All rights reserved.", "all-rights-reserved"), ("All rights reserved.", ""), ("plain", ""),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(docs(*[t for t, _ in cases])).collect()}
    # The Apache notice and its short form share a label; a base phrase alone scores a half.
    assert got == {i: (label, 1.0 if label else 0.0) for i, (_, label) in enumerate(cases)}
    span = license_scan(docs("x y. Copyright 2020: all rights reserved!")).first().spans[0]
    assert (span.start, span.stop) == (2, 7) and words_of("Ä1_b".encode()) == ["Ä1".encode(), b"b"]
    with pytest.raises(ValueError, match="mandatory"):
        compile_template("x", "{{a}} [[2]]")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), {s for s in names if sizes[s]}, {s: 0.0 for s in names}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def mixed(df):
    rows = [r.asDict() for r in mix_sources(df).collect()]
    source = {}
    for r in df.select("doc_id", "source").collect():
        source[r.doc_id] = r.source
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(source[r["doc_id"]], []).append(r)
    want = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        size = sum(r["size"] for r in rs)
        assert {r["source_size"] for r in rs} == {size} and all(abs(r["target"] - want[s]) < 1e-6 for r in rs)
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= max(2, 0.01 * size)
    return sorted(map(str, rows))


def test_mix_targets_and_reruns(docs):
    rows = [(i, " ".join(["w"] * (i * 37 % 200)), "en", f"s{min(i % 17, 6)}" if i % 29 else None) for i in range(400)]
    df = docs(*rows)
    assert mixed(df) == mixed(df.repartition(3))


def test_mix_odd_rows(odd):
    out = {(r.doc_id, r.size, r.taken) for r in mix_sources(odd).collect()}
    assert {(d, s) for d, s, _ in out} == {(1, 6), (2, 0), (3, 0), (None, 6), (4, 6), (5, 0), (6, 30000), (7, 1), (8, 4)}
    assert mix_sources(odd).count() == odd.count() and mix_sources(odd.filter("false")).count() == 0


def test_all_empty_texts(docs):
    assert {(r.size, r.target, r.taken) for r in mix_sources(docs(None, "", " ")).collect()} == {(0, 0.0, 0)}


def test_targets_reshare_the_excess(spark):
    src = spark.createDataFrame([((False, "a"), 10), ((False, "b"), 1000), ((True, ""), 0), ((False, "c"), 5)], "key struct<missing:boolean,name:string>, source_size long")
    got = {r.key.name if not r.key.missing else None: r.target for r in targets(src).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 1000, None: 0, "c": 5}))
