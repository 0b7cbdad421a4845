"""The registered queries of the corpus operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.language_id import language_id
from vellum.llm.license_scan import PHRASES, TEMPLATES, license_scan
from vellum.llm.mixing import mix_sources
from vellum.llm.near_dedup import near_dedup
from vellum.llm.packing import pack
from vellum.llm.quality import quality_scores
from vellum.llm.tokens import TOKENIZER, length_histogram, token_lengths
from vellum.llm.topk_search import topk_search
from vellum.llm.toxicity import toxicity_scores
from vellum.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_topk_search": op3_topk_search,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_source_mix": op8_source_mix,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
}

#: A-Z to a-z only, for DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_regex(markup: str) -> str:
    """A template as a regular expression over words with a space after each."""
    marks = {"{{": "(?:", "}}": ")?"}
    tokens = re.findall(r"\{\{|\}\}|\[\[\d+\]\]|[^\s{}\[\]]+", markup)
    return " " + "".join(marks.get(t) or (f"(?:[^ ]+ ){{0,{t[2:-2]}}}" if t.startswith("[[") else f"{t} ") for t in tokens)


_PLACES = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()})" for p in PHRASES)
_BASE = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
_FOUND = ", ".join(f"CASE WHEN regexp_matches(line, '{_template_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES)
_JOINED = "coalesce(array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ','), '')"

ORACLES: dict[str, str] = {
    "op4_license_scan": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t),
             f AS (SELECT doc_id, w, {_PLACES} AS places, [{_BASE}] AS base, [{_FOUND}] AS found FROM u)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
               {_JOINED.format("base")} AS base_labels, {_JOINED.format("base || found")} AS labels,
               CASE WHEN len(list_filter(found, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
        FROM f""",
    "op3_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
    "op10_near_dedup": f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t),
             e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
             r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
             c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
}
