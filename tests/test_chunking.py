import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators.chunking import chunk_documents, chunk_markdown, chunk_pages, chunk_text, markdown_chunks, paragraph_chunks


def chunks(text, size=500, overlap=100):
    return list(paragraph_chunks(text, size, overlap))


def test_paragraph_goldens():
    assert chunks("one short note") == ["one short note"]
    assert chunks("") == chunks(" \n ") == []
    # A paragraph that would reach the size closes the chunk; the next begins with its last five characters.
    assert chunks("red kite.\n\nblue tit.\n\ngrey heron.\n\nblack swan.", 26, 5) == ["red kite.\n\nblue tit.", "tit. grey heron.", "eron. black swan."]
    assert [len(c) for c in chunks("word " * 200, 300, 50)] == [299, 299, 299, 249]
    assert [len(c) for c in chunks("word " * 300)] == [499, 499, 499, 299]


def test_markdown_goldens():
    assert list(markdown_chunks("pre\n# A\nbody a\n\n## B\nbody b")) == ["pre", "# A\n\nbody a", "## B\n\nbody b"]
    assert list(markdown_chunks("####### seven\n#none\n")) == ["####### seven\n#none"]
    long = "# H\n" + "word " * 200
    assert all(len(c) <= 500 for c in markdown_chunks(long)) and list(markdown_chunks(long))[:2] == ["# H", ("word " * 100).strip()]


def test_page_goldens(spark):
    two = ["Kites glide low. Herons wait at the water's edge. Swans do not.", "Owls sleep by day. Larks sing."]
    df = spark.createDataFrame([(["", "Only this page", " "], two)], "a array<string>, b array<string>")
    row = df.select(chunk_pages(F.col("a")).alias("a"), chunk_pages(F.col("b"), 60, 10).alias("b"), chunk_pages(F.lit(None).cast("array<string>")).alias("n")).first()
    assert [(c.chunk_index, c.page, c.text) for c in row.a] == [(0, 2, "Only this page")]
    assert [(c.page, c.text) for c in row.b] == [(1, "Kites glide low.  Herons wait at the water's edge."), (2, "r's edge.  Swans do not. Owls sleep by day.  Larks sing.")]
    assert row.n is None


def test_punctuation_only_page(spark):
    row = spark.createDataFrame([(["...", "Hi there. ...Yes! no tail"],)], "p array<string>").select(chunk_pages(F.col("p")).alias("c")).first()
    assert row.c[0].text == "... Hi there.  Yes!  no tail"


@pytest.mark.parametrize(("size", "overlap"), [(100, 100), (0, 0), (10, -1), (100, 31)])
def test_unsafe_options_are_rejected(size, overlap):
    with pytest.raises(ValueError, match="overlap"):
        chunk_text(F.lit("x"), size, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!é", max_size=400), st.integers(10, 80), st.floats(0, 0.3))
def test_paragraph_invariants(text, size, share):
    overlap = int(size * share)
    out = chunks(text, size, overlap)
    assert all(c.strip() and len(c) <= size for c in out)
    bare = re.sub(r"\s", "", text)
    ends = {0}  # where the chunks so far may end: every character of the text is covered, in order
    for c in (re.sub(r"\s", "", c) for c in out):
        ends = {at - k + len(c) for at in ends for k in range(min(at, overlap) + 1) if bare.startswith(c, at - k)}
    assert len(bare) in ends


def test_routes_and_udfs(spark):
    rows = [("a.md", "# A\nx", None), ("a.MD", "# A\nx", None), ("a.markdown", "# A\nx", None), ("a.md", "t", ["p one.", "p two."]), ("n.txt", None, None)]
    df = chunk_documents(spark.createDataFrame(rows, "name string, text string, pages array<string>"))
    got = sorted((r.name, r.text, [(c.text, c.page) for c in r.chunks] if r.chunks is not None else None) for r in df.collect() if r.text is not None)
    assert got == [("a.MD", "# A\nx", [("# A\nx", None)]), ("a.markdown", "# A\nx", [("# A\n\nx", None)]), ("a.md", "# A\nx", [("# A\n\nx", None)]), ("a.md", "t", [("p one. p two.", 2)])]
    assert spark.range(1).select(chunk_markdown(F.lit(None).cast("string")).alias("c")).first().c is None
