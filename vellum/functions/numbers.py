"""Numeric, date, id and vector functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the nearest integer, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def map_range(value: Column, total: Column, low: float, high: float) -> Column:
    """value of total, mapped to low..high and rounded; high if total is not positive."""
    at = low + value / F.when(total > 0, total) * (high - low)
    return F.coalesce(half_up(at), F.lit(int(high))).cast("int")


def score_percent(score: Column) -> Column:
    return half_up(score * 100).cast("int")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "mid").otherwise("low")


def four_digits(score: Column) -> Column:
    return F.format_string("%.4f", score)


def file_size(n: Column) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def size_kb(n: Column) -> Column:
    return F.format_string("%.2f KB", n / 1024)


def complement(weight: Column) -> Column:
    """The other side's weight, on the slider's grid of tenths."""
    return F.round(1 - weight, 1)


def weight_mode(vector_weight: Column) -> Column:
    return F.when(vector_weight == 0.5, "balanced").when(vector_weight < 0.5, "keyword").otherwise("semantic")


def clamp(x: Column, low: float, high: float | None = None) -> Column:
    x = F.greatest(F.coalesce(x, F.lit(low)), F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def chunk_id(library_id: Column, document_id: Column, chunk_index: Column) -> Column:
    """The same id whenever the same chunk is made again."""
    return F.sha2(F.concat_ws("|", library_id, document_id, chunk_index.cast("string")), 256)


def whole_number(text: Column) -> Column:
    """Leading digits as an int; null if there are none or too many."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def dot(a: Column, b: Column) -> Column:
    """In double precision, whatever the vectors' type."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero, or vectors of different dimensions."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))
