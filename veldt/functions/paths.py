"""Paths with either separator: names, extensions, directories, shares, wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """Back slashes as separators, the long-path prefix of a share removed."""
    return F.regexp_replace(F.translate(path, "/", "\\"), r"^\\\\\?\\UNC\\", r"\\\\")


def leaf(path: Column) -> Column:
    """The last segment, trailing separators apart."""
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)


def extension(name: Column) -> Column:
    """From the last dot on in lower case, so the whole of a dot file's name; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.\\/]*)$", 1))


def ancestors(path: Column) -> Column:
    """The directories above a path, outermost first, each as a path."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", ""), "/")
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.filter(F.when(F.size(parts) > 1, whole).otherwise(F.array().cast("array<string>")), lambda p: p != "")


def share(path: Column) -> Column:
    """The share's name of \\\\host\\share\\...; empty for other paths."""
    return F.regexp_extract(normal(path), r"^\\\\[^\\]+\\([^\\]+)", 1)


def host(path: Column) -> Column:
    return F.regexp_extract(normal(path), r"^\\\\([^\\]+)\\", 1)


def same_host(a: Column, b: Column) -> Column:
    """Equal without regard to case, or a short name and a full one with the same first label; addresses are never short."""
    x, y = F.lower(a), F.lower(b)
    short = lambda c: ~c.contains(".") & ~c.rlike(r"^[0-9.]+$|:|\.ipv6-literal\.net$")
    full = lambda c: c.contains(".") & ~c.rlike(r"^[0-9.]+$|:|\.ipv6-literal\.net$")
    label = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    return (x == y) | (((short(x) & full(y)) | (full(x) & short(y))) & (label(x) == label(y)))


def looks_like_regex(pattern: str) -> bool:
    return any(c in pattern for c in "*?[\\^$+{|()")


def wildcard_regex(pattern: str, escapes: bool = True) -> str:
    """A regular expression for the whole text: * and ? as usual, a back slash takes the next character as it is if
    `escapes`; without regard to case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and escapes and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def likes(text: Column, pattern: str, escapes: bool = True) -> Column:
    return text.rlike(wildcard_regex(pattern, escapes))
