"""Column helpers for operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable isn't inlined as a projected column may be."""
    return F.transform(F.array(value), body)[0]


def shift_left(c: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", c, bits)


def shift_right(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c, bits)


def space_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case for comparison with ASCII words: full lower-casing, which maps only the Kelvin sign to a bare ASCII letter, so that sign is exchanged first. Word boundaries and counts don't change."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))


def up_to(first: int, last: Column) -> Column:
    """first..last, empty if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
