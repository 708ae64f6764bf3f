"""Identifiers that carry a check digit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the published check digits.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _at(value: Column, k: int) -> Column:
    return F.ascii(F.substring(value, k + 1, 1)) - 48


def luhn(value: Column) -> Column:
    """The digits of the value, whatever parts them, have a Luhn sum divisible by 10 (and there are some)."""
    d = digits(value)
    return F.when(F.length(d) > 0, F.call_function("luhn_check", d)).otherwise(False)


def iban(value: Column) -> Column:
    """15 to 34 letters and digits, two letters then two digits, and a remainder of 1 modulo 97 after moving the first four
    to the end and reading letters as 10 to 35."""
    v = F.upper(F.regexp_replace(value, "\\s", ""))
    moved = F.concat(F.substring(v, 5, 34), F.left(v, F.lit(4)))
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda r, c: step(r, c).cast("int"))
    return F.when(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def tfn(value: Column) -> Column:
    """An Australian tax file number: nine digits, weighted sum divisible by 11."""
    d = digits(value)
    total = sum((_at(d, k) * w for k, w in enumerate(TFN_WEIGHTS)), F.lit(0))
    return F.when(F.length(d) == 9, total % 11 == 0).otherwise(False)


def medicare(value: Column) -> Column:
    """An Australian Medicare number: 10 or 11 digits, the first from 2 to 6, the ninth a weighted sum modulo 10."""
    d = digits(value)
    total = sum((_at(d, k) * w for k, w in enumerate(MEDICARE_WEIGHTS)), F.lit(0))
    return F.when(F.length(d).isin(10, 11), _at(d, 0).between(2, 6) & (total % 10 == _at(d, 8))).otherwise(False)


def contextual_identifier(value: Column) -> Column:
    """What follows the first : or =: 5 to 32 characters, not all letters, and no digits-only value of fewer than three
    distinct digits."""
    v = F.trim(F.regexp_replace(F.regexp_extract(value, "[:=](.*)$", 1), "^[\\s\"']+|[\\s\"']+$", ""))
    distinct = F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != "")))
    return F.length(v).between(5, 32) & ~v.rlike("^[A-Za-z]+$") & ~(v.rlike("^[0-9]+$") & (distinct < 3))
