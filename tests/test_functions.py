from pyspark.sql import functions as F

from vellum.functions import numbers as N
from vellum.functions import text as X
from vellum.functions.locate import find_chunk, highlight, locate
from vellum.sources import files as P


def values(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_text(spark):
    t = F.lit("\n\t a b  ﻿")
    assert values(spark, X.trim(t), X.blank(F.lit("  ")), X.strip_spaces(t), X.index_of(F.lit("abcab"), F.lit("ab")), X.last_index_of(F.lit("a. b. c"), ". "), X.last_index_of(F.lit("x"), ". ")) == ["a b", True, "ab", 0, 4, -1]
    assert values(spark, X.url_component(F.lit("a b+c&ü")), X.counted(F.lit(1), "result"), X.counted(F.lit(0), "result"), X.terms(F.lit("Über-Größe 2x, x!"))) == ["a%20b%2Bc%26%C3%BC", "1 result", "0 results", ["über", "größe", "2x", "x"]]
    assert values(spark, X.sentences(F.lit("Hi there. ...Yes! no tail")), X.sentences(F.lit("...")))[0] == ["Hi there. ", "Yes! ", "no tail"]


def test_numbers(spark):
    m = lambda v, t, a, b: N.map_range(F.lit(v), F.lit(t), a, b)
    assert values(spark, m(1, 2, 15, 90), m(0, 0, 0, 10), N.half_up(F.lit(-2.5)), N.score_percent(F.lit(0.855))) == [53, 10, -2, 86]
    assert values(spark, *[N.file_size(F.lit(n)) for n in (500, 1536, 2621440, 1280)]) == ["500 B", "1.5 KB", "2.5 MB", "1.3 KB"]
    assert values(spark, *[N.score_band(F.lit(s)) for s in (0.8, 0.6, 0.59)], *[N.weight_mode(F.lit(w)) for w in (0.5, 0.2, 0.9)], N.complement(F.lit(0.3))) == ["high", "mid", "low", "balanced", "keyword", "semantic", 0.7]
    assert values(spark, N.whole_number(F.lit("12px")), N.whole_number(F.lit("x")), N.iso_date(F.lit(1_700_000_000_000)), N.clamp(F.lit(-3), 1), N.four_digits(F.lit(0.5))) == [12, None, "2023-11-14", 1, "0.5000"]
    vec = lambda *v: F.array(*map(F.lit, v))
    assert values(spark, N.cosine(vec(3.0, 4.0), vec(3.0, 4.0)), N.cosine(vec(0.0, 0.0), vec(1.0, 0.0)), N.cosine(vec(1.0), vec(1.0, 2.0))) == [1.0, None, None]


def test_types_and_routes(spark):
    t = lambda m, n: P.document_type(F.lit(m), F.lit(n))
    assert values(spark, t("application/pdf", "x"), t("", "doc.md"), t("", "a.markdown"), t("", "A.MD"), t("", "a.docx")) == ["pdf", "md", "txt", "txt", "docx"]
    assert values(spark, P.accepted(F.lit(""), F.lit("A.MD")), P.accepted(F.lit("text/plain"), F.lit("x")), P.accepted(F.lit(""), F.lit("x.png"))) == [True, True, False]
    assert values(spark, P.parser_route(F.lit(""), F.lit("X.PDF")), P.parser_route(F.lit("application/pdf"), F.lit("x"))) == ["text", "pdf"]


def test_locate():
    assert locate("Hello   world foo", "Hello world") == (0, 13)
    assert locate("abc", "b") == (1, 2) and locate("abc", "x") is None and locate("", "") == (0, 0)
    core = "".join(chr(97 + i % 26) for i in range(60))
    text = "start " + core + " end"
    assert locate(text, "Z" * 60 + core) == (0, 66)
    assert locate(text, "Z" * 200 + core[:10]) is None


def test_highlight(spark):
    df = spark.createDataFrame([("one  two three", "one two"), ("abc", "zzz"), (None, "x")], "t string, c string")
    at = find_chunk(F.col("t"), F.col("c"))
    rows = df.withColumn("at", at).select(*[c.alias(n) for c, n in zip(highlight(F.col("t"), F.col("at")), "bma", strict=True)]).collect()
    assert [tuple(r) for r in rows] == [("", "one  two", " three"), ("abc", "", ""), (None, "", "")]
