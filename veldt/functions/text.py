"""Strings of findings: entropy, masks, hashes, snippets, evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET, WINDOW, LINE = 50, 512, 240


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty or null value."""
    counts = lambda s: F.transform(F.array_distinct(s), lambda c: F.size(F.filter(s, lambda x: x == c)) / F.size(s))
    shares = F.transform(F.array(F.split(F.coalesce(value, F.lit("")), "")), counts)[0]
    bits = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(F.length(F.coalesce(value, F.lit(""))) == 0, 0.0).otherwise(bits)


def mask(value: Column) -> Column:
    """The first two characters, the rest as stars; all stars up to two."""
    n = F.length(value)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 2)))


def value_hash(value: Column) -> Column:
    """Base64 of SHA-256 of the UTF-8 bytes."""
    return F.base64(F.unhex(F.sha2(value, 256)))


def around(text: Column, index: Column, length: Column, width: int) -> Column:
    """The characters from `width` before a match (index from 0) to `width` after it."""
    start = F.greatest(F.lit(0), index - width)
    stop = F.least(F.length(text), index + length + width)
    return F.substring(text, start + 1, stop - start)


def one_line(text: Column, width: int = LINE) -> Column:
    """A text on one line, shortened with three dots beyond `width`."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "\r", ""), "\n", " "))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("..."))).otherwise(flat)


def evidence(snippet: Column) -> Column:
    """Carriage returns dropped, line feeds to blanks, ANSI colour codes stripped, trimmed."""
    plain = F.regexp_replace(snippet, "\\x1B\\[[0-9;]*[A-Za-z]", "")
    return F.trim(F.translate(F.regexp_replace(plain, "\r", ""), "\n", " "))


def highlight(snippet: Column, start: Column, length: Column) -> Column:
    """The snippet with [[ ]] around the match; unchanged where the match isn't inside."""
    inside = (start >= 0) & (start + length <= F.length(snippet))
    made = F.concat(F.substring(snippet, F.lit(1), start), F.lit("[["), F.substring(snippet, start + 1, length), F.lit("]]"), F.substring(snippet, start + length + 1, F.length(snippet)))
    return F.when(inside, made).otherwise(snippet)


def locate(snippet: Column, value: Column, known: Column) -> Column:
    """Where a value is in its snippet: at the known offset if it is there, else its first place, else its first place
    without regard to case, else -1."""
    there = F.substring(snippet, known + 1, F.length(value)) == value
    exact, folded = F.instr(snippet, value) - 1, F.instr(F.lower(snippet), F.lower(value)) - 1
    return F.when((known >= 0) & there, known).when(exact >= 0, exact).otherwise(folded)


def is_metadata_only(value: Column, snippet: Column) -> Column:
    """A finding without value and snippet, or with the constant of a metadata match."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (blank(value) & blank(snippet)) | (value == "[METADATA MATCH]")
