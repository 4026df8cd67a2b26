"""Stable content-hash identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT_SEPARATOR = "\x1f"


def _text(part: Column | str) -> Column:
    return (F.col(part) if isinstance(part, str) else part).cast("string")


def prefixed_id(prefix: str, separator: str, *parts: Column | str) -> Column:
    """``prefix`` and the first 16 upper-case hex digits of the SHA-256 of the joined parts.

    A null part counts as the empty text.
    """
    joined = F.concat_ws(separator, *[F.coalesce(_text(part), F.lit("")) for part in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(joined, 256), 1, 16)))


def brand_id(brand: Column | str) -> Column:
    return prefixed_id("BRAND_", UNIT_SEPARATOR, brand)


def branch_id(brand: Column | str, address: Column | str, unit: Column | str) -> Column:
    return prefixed_id("BRANCH_", UNIT_SEPARATOR, brand, address, unit)


def offering_id(branch: Column | str, subject: Column | str, level: Column | str) -> Column:
    return prefixed_id("OFFER_", UNIT_SEPARATOR, branch, subject, level)


def evidence_id(entity: Column | str, source: Column | str, observed_at: Column | str, kind: Column | str) -> Column:
    return prefixed_id("EVID_", UNIT_SEPARATOR, entity, source, observed_at, kind)


def query_id(area: Column | str, channel: Column | str, text: Column | str) -> Column:
    return prefixed_id("QRY_", UNIT_SEPARATOR, area, channel, text)


def review_id(entity_type: Column | str, entity: Column | str, issue: Column | str) -> Column:
    return prefixed_id("CREV_", UNIT_SEPARATOR, entity_type, entity, issue)


def station_complex_id(normalized_name: Column | str) -> Column:
    return prefixed_id("STC_", UNIT_SEPARATOR, normalized_name)


def node_id(station_complex: Column | str) -> Column:
    return prefixed_id("NODE_", UNIT_SEPARATOR, station_complex)


def station_review_id(station_complex: Column | str, issue: Column | str) -> Column:
    return prefixed_id("REV_", "|", station_complex, issue)


def walk_request_id(node: Column | str, exit_point: Column | str, coordinate_key: Column | str) -> Column:
    return prefixed_id("CW_", "|", node, exit_point, coordinate_key, F.lit("walk"))
