"""Text and key normalisation with the semantics of Python's own str and number types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus U+001C..U+001F, which Python strips and (?U)\s misses.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}ªº"
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

UNKNOWN = "Desconhecido"
OTHER = "Outros"

# The whole-value remap of academic levels, applied after title-casing.
ACADEMIC_LEVELS = {
    "Ensino Medio Completo": "Ensino Médio Completo",
    "Ensino Medio Incompleto": "Ensino Médio Incompleto",
    "Ensino Tecnico Completo": "Ensino Técnico Completo",
    "Ensino Tecnico Cursando": "Ensino Técnico Cursando",
    "Pos Graduacao": "Pós-Graduação",
    "Pos Graduacao Cursando": "Pós-Graduação Cursando",
    "Doutorado Cursando": "Doutorado (Cursando)",
    "Mestrado Cursando": "Mestrado (Cursando)",
}


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def title_case(c: Column) -> Column:
    """Strip, then capitalise each run of cased letters: a letter after an apostrophe, digit or hyphen is upper-cased, which initcap alone doesn't do."""
    runs = F.regexp_extract_all(strip(c), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def safe_key(c: Column) -> Column:
    """Canonical join key as text: what reads as a number becomes its integer part (toward zero), anything else its stripped text, null the text 'None'.

    Integer parts beyond the signed 64-bit range stay text, as do infinities; 2^63 itself clamps.
    """
    text = strip(c.cast("string"))
    whole = F.regexp_replace(text, "_", "").try_cast("double").try_cast("bigint").cast("string")
    return F.when(c.isNull(), F.lit("None")).when(text.rlike(_NUMBER), F.coalesce(whole, text)).otherwise(text)


def remap(c: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value replacement; values outside the mapping, and null, pass through."""
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def fill_unknown(c: Column, value: str = UNKNOWN) -> Column:
    """Null becomes a sentinel, other values their text."""
    return F.coalesce(c.cast("string"), F.lit(value))


def round_half_even(c: Column, places: int = 8) -> Column:
    """Banker's rounding, as Python's round()."""
    return F.bround(c, places)


def percent_label(count: Column, percent: Column) -> Column:
    """'count\\n(pp.p%)', the cell text of a confusion chart."""
    return F.format_string("%d\n(%.1f%%)", count.cast("bigint"), percent.cast("double"))
