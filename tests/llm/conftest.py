import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of documents from texts, or from (doc_id, text[, lang[, source]])."""

    def make(*rows):
        full = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) for r in full], DOCS)

    return make


@pytest.fixture
def odd(spark, docs):
    """Nulls in any column, empty and white texts, ties, a repeated row, a very long text, and extra columns with clashing names."""
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    base = docs((1, "One two three four five six."), (2, None), (3, ""), (None, "no id here at all now"), (4, "one TWO three four five six."), (4, "one TWO three four five six."), (5, " \t\n"), (6, long), (7, "x", None, None), (8, "Äé ß 中文 字", "de", None))
    return base.withColumns({"size": F.lit("clash"), "rank": F.lit(1), "score": F.lit(-1.0), "key": F.lit("k"), "bucket": F.lit(3), "length": F.lit(0), "y": F.lit(5), "text_sha256": F.lit("q")})

