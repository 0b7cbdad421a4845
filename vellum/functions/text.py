"""String functions, as columns. Lengths and positions are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as a regex class.
SPACE = r"\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def trim(text: Column) -> Column:
    """Without white space at both ends (all kinds, not just U+0020)."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def blank(text: Column) -> Column:
    return trim(text) == ""


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+", "")


def index_of(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.instr(text, part) - 1


def last_index_of(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    at = F.instr(F.reverse(text), F.lit(part[::-1]))
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def url_component(text: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def around(text: Column, start: Column, end: Column) -> list[Column]:
    """before, match and after of a half-open range."""
    return [F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text))]


def terms(text: Column) -> Column:
    """Search terms: lower case, split at all but letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences with their trailing white space; a text without any match is one sentence."""
    found = F.regexp_extract_all(text, F.lit(rf"[^.!?]+[.!?]+[{SPACE}]*|[^.!?]+\z"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(text)).otherwise(found)
