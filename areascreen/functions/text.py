"""Text normalisation as Column expressions: exact, never fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns and abbreviations of the address rules.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
UNIT_NUMBER = r"#\s*(\d+)\s*-\s*(\w+)"
PARENTHETICAL = r"\s*\([^)]*\)"
UNIT_SUFFIX = r"\s*#\s*[A-Z0-9]+\s*-\s*[A-Z0-9/]+.*$"
LEADING_BLOCK = r"^BLK\s+"
ROAD_WORDS = {"LOR": "LORONG", "ST": "STREET", "AVE": "AVENUE", "RD": "ROAD", "DR": "DRIVE"}
STATION_SUFFIX = r"\s+(?:MRT|LRT)\s+STATION$"
STATION_CODE = r"^[A-Z]{2}\d+[A-Z]?$"


def squeeze(value: Column) -> Column:
    """Collapse runs of whitespace to one blank and strip the ends."""
    return F.trim(F.regexp_replace(value, WHITESPACE, " "))


def normalize_name(value: Column) -> Column:
    return F.upper(squeeze(value))


def normalize_address(value: Column) -> Column:
    """Upper case, single blanks, unit numbers written ``#01-02``."""
    return F.regexp_replace(normalize_name(value), UNIT_NUMBER, "#$1-$2")


def normalize_building_address(value: Column) -> Column:
    """Comparison key of the building: no block word, unit or place label; road words spelled out."""
    text = F.regexp_replace(normalize_address(value), PARENTHETICAL, "")
    text = F.regexp_replace(text, UNIT_SUFFIX, "")
    text = F.replace(F.regexp_replace(text, LEADING_BLOCK, ""), F.lit(","), F.lit(" "))
    for short, long in ROAD_WORDS.items():
        text = F.regexp_replace(text, rf"\b{short}\b", long)
    return squeeze(text)


def normalize_postal_code(value: Column) -> Column:
    """Six digits; five are left-padded; anything else is null."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) == 6, digits).when(F.length(digits) == 5, F.lpad(digits, 6, "0"))


def station_base_name(value: Column) -> Column:
    return F.regexp_replace(normalize_name(value), STATION_SUFFIX, "")


def rail_mode(normalized: Column) -> Column:
    return (
        F.when(normalized.endswith(" LRT STATION"), "lrt")
        .when(normalized.endswith(" MRT STATION"), "mrt")
        .when(normalized.rlike(STATION_CODE), "mrt_code_only_unverified")
        .otherwise("unknown")
    )


def display_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r" MRT STATION$", ""), r" LRT STATION$", "")


def sanitize_url(value: Column) -> Column:
    """Drop the query and the fragment."""
    return F.regexp_replace(value, r"(?s)[?#].*$", "")


def is_url_or_null(value: Column) -> Column:
    return value.isNull() | F.coalesce(value.rlike(r"^https?://\S+$"), F.lit(False))


def contains_text(value: Column, needle: str) -> Column:
    """Case-insensitive substring test; null counts as empty text."""
    return F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(needle.lower()))


def is_vague_lead(note: Column, markers: list[str]) -> Column:
    """Whether the note carries one of the marker phrases."""
    test = F.lit(False)
    for marker in markers:
        test = test | contains_text(note, marker)
    return test
