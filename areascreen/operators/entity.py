"""Exact entity resolution: canonical fields, supported unit filling, grouping, reviews.

Nothing is matched by similarity. Groups may be of any size: every rule is stated over
counts, minima and maxima, and sources are listed as rows, never gathered into one value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions import ids, text
from areascreen.operators.skew import salted_join
from areascreen.session import cut_lineage


#: A table of up to so many rows is sent whole to the tasks that look something up in it.
LOOKUP_ROWS = 10_000


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _look_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a table of unique keys; a short one needs no count of the rows' keys and no shuffle of the rows."""
    if found.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(found), keys, "left")
    return salted_join(rows, found, keys, spread=["candidate_id"], how="left")


def apply_canonical_fields(candidates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Validated fields replace raw ones before matching; brand aliases map to one name.

    ``aliases`` has unique ``alias`` (normalised) and ``canonical_brand``.
    """
    brand = text.normalize_name(F.col("brand_name"))
    rows = candidates.withColumn("brand", brand)
    if aliases is not None:
        rows = _look_up(rows, aliases.select(F.col("alias").alias("brand"), "canonical_brand"), ["brand"]).withColumn("brand", F.coalesce("canonical_brand", "brand")).drop("canonical_brand")
    address = F.coalesce(_blank_to_null("canonical_address"), F.col("address_raw"))
    postal = F.coalesce(_blank_to_null("canonical_postal_code"), _blank_to_null("postal_code"))
    unit = F.coalesce(_blank_to_null("canonical_unit"), _blank_to_null("unit"))
    return rows.withColumns({
        "address": address, "unit": unit, "postal": text.normalize_postal_code(postal),
        "normalized_address": text.normalize_address(address), "building": text.normalize_building_address(address),
    })


def supported_units(records: DataFrame) -> DataFrame:
    """Per brand and building with missing units and a supporting identity: the verdict.

    A missing unit is filled only when exactly one complete validated identity, one explicit
    unit and one supported postal code exist, nothing conflicts and no other postal code is known.
    """
    canonical_postal = text.normalize_postal_code(F.col("canonical_postal_code"))
    supports = (
        _blank_to_null("canonical_address").isNotNull() & canonical_postal.isNotNull() & _blank_to_null("canonical_unit").isNotNull()
        & (text.normalize_building_address(F.col("canonical_address")) == F.col("building"))
    )
    identity = F.when(supports, F.struct(
        text.normalize_address(F.col("canonical_address")).alias("address"), canonical_postal.alias("postal"),
        F.col("canonical_unit").alias("unit"),
    ))
    rows = records.withColumn("_identity", identity)
    grouped = rows.groupBy("brand", "building").agg(
        F.count_if(F.col("unit").isNull()).alias("missing_units"),
        F.min("_identity").alias("first_identity"), F.max("_identity").alias("last_identity"),
        F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"),
        F.min("postal").alias("first_postal"), F.max("postal").alias("last_postal"),
        F.bool_or(F.coalesce("identity_conflict", F.lit(False))).alias("conflict"),
        F.min(F.when(F.col("_identity").isNotNull(), F.struct("seq", "candidate_id"))).alias("supporter"),
    ).filter((F.col("missing_units") > 0) & F.col("first_identity").isNotNull())
    one_identity = F.col("first_identity") == F.col("last_identity")
    one_unit = F.col("first_unit").isNotNull() & (F.col("first_unit") == F.col("last_unit"))
    postal_fits = F.coalesce(
        (F.col("first_postal") == F.col("first_identity.postal")) & (F.col("last_postal") == F.col("first_identity.postal")),
        F.lit(True),
    )
    issue = F.when(
        F.col("conflict") | (F.col("first_postal") < F.col("last_postal")), "conflicting_identity_evidence"
    ).otherwise("ambiguous_missing_unit_identity")
    resolved = one_identity & F.coalesce(one_unit, F.lit(False)) & ~F.col("conflict") & postal_fits
    return grouped.select(
        "brand", "building", resolved.alias("resolved"), F.when(~resolved, issue).alias("issue_category"),
        F.when(resolved, F.col("first_identity")).alias("identity"),
        F.col("supporter.candidate_id").alias("supporting_candidate_id"), "missing_units",
    )


def _review(entity_type: str, reference: Column, issue: Column, entity: Column | None = None) -> list[Column]:
    return [
        ids.review_id(F.lit(entity_type), entity if entity is not None else reference, issue).alias("review_item_id"),
        F.lit(entity_type).alias("entity_type"), reference.cast("string").alias("entity_reference"),
        issue.alias("issue_category"), F.lit("open").alias("status"),
    ]


class Resolution:
    """Result tables of :func:`deduplicate`, each worked out when it is first asked for."""

    _KEYS = ["brand", "postal_key", "address_key", "unit_key"]

    def __init__(self, records: DataFrame):
        self._records = records

    @cached_property
    def _verdicts(self) -> DataFrame:
        return cut_lineage(supported_units(self._records))

    @cached_property
    def _keyed(self) -> DataFrame:
        fills = self._verdicts.filter("resolved").select("brand", "building", F.col("identity").alias("_fill"))
        filled = _look_up(self._records, fills, ["brand", "building"])
        fill = F.col("unit").isNull() & F.col("_fill").isNotNull()
        filled = filled.withColumns({
            "address": F.when(fill, F.col("_fill.address")).otherwise(F.col("address")),
            "normalized_address": F.when(fill, F.col("_fill.address")).otherwise(F.col("normalized_address")),
            "postal": F.when(fill, F.col("_fill.postal")).otherwise(F.col("postal")),
            "unit": F.when(fill, F.col("_fill.unit")).otherwise(F.col("unit")),
        }).drop("_fill")
        return filled.withColumns({
            "postal_key": F.coalesce("postal", F.lit("")), "unit_key": F.coalesce("unit", F.lit("")),
            "address_key": F.when(F.col("postal").isNull(), F.col("normalized_address")).otherwise(""),
        }).select("candidate_id", "seq", "brand", "brand_name", "address", "normalized_address", "postal_key", "unit_key", "address_key")

    def _grouped(self, keyed: DataFrame) -> DataFrame:
        return keyed.groupBy(*self._KEYS).agg(
            F.min(F.struct("seq", "candidate_id", "brand_name", "address", "normalized_address")).alias("first"),
            F.count(F.lit(1)).alias("source_candidate_count"),
        ).withColumn("branch_id", ids.branch_id("brand", "first.normalized_address", "unit_key"))

    @cached_property
    def branches(self) -> DataFrame:
        return self._grouped(self._keyed).select(
            "branch_id", F.col("first.brand_name").alias("brand_name"), F.col("brand").alias("normalized_brand_name"),
            F.col("first.address").alias("address_raw"), F.col("first.normalized_address").alias("normalized_address"),
            F.nullif("postal_key", F.lit("")).alias("postal_code"), F.nullif("unit_key", F.lit("")).alias("unit"), "source_candidate_count",
        )

    @cached_property
    def memberships(self) -> DataFrame:
        # Read by the grouping, the join and the search for hot keys: written once.
        keyed = cut_lineage(self._keyed)
        return salted_join(
            keyed.select(*self._KEYS, "candidate_id"), self._grouped(keyed).select(*self._KEYS, "branch_id"), self._KEYS, spread=["candidate_id"]
        ).select("branch_id", "candidate_id")

    @cached_property
    def reviews(self) -> DataFrame:
        groups = cut_lineage(self._grouped(self._keyed))
        building_ref = F.concat_ws("|", "brand", "building")
        identity_reviews = self._verdicts.filter(~F.col("resolved")).select(*_review("branch_group", building_ref, F.col("issue_category")))
        postal_groups = groups.filter(F.col("postal_key") != "").groupBy("brand", "postal_key").agg(
            F.bool_or(F.col("unit_key") == "").alias("missing"), F.bool_or(F.col("unit_key") != "").alias("known")
        ).filter("missing AND known")
        unit_reviews = postal_groups.select(
            *_review("branch_group", F.concat_ws("|", "brand", "postal_key"), F.lit("ambiguous_unit_within_postal"))
        )
        postal_reviews = groups.filter(F.col("postal_key") == "").select(*_review(
            "branch_candidate", F.col("first.candidate_id"), F.lit("missing_or_invalid_postal_code"),
            F.concat_ws("|", "brand", "address_key", "unit_key"),
        ))
        return identity_reviews.unionByName(unit_reviews).unionByName(postal_reviews)

    @cached_property
    def resolutions(self) -> DataFrame:
        return self._verdicts.filter("resolved")


def deduplicate(candidates: DataFrame, aliases: DataFrame | None = None) -> Resolution:
    """Group candidates into branches on exact (brand, postal, unit).

    Needs candidate_id, seq (input order), brand_name, address_raw, postal_code, unit,
    canonical_address, canonical_postal_code, canonical_unit, identity_conflict. Without a
    postal code only identical (brand, address, unit) rows merge. A missing unit beside known
    units under one postal code is reviewed, never merged.
    """
    return Resolution(apply_canonical_fields(candidates, aliases))


def brands_of(branches: DataFrame) -> DataFrame:
    """Brands rebuilt from the branches that were kept."""
    return branches.select(ids.brand_id("normalized_brand_name").alias("brand_id"), "normalized_brand_name").distinct()


def offerings(branches: DataFrame, *, subject: str) -> DataFrame:
    """One row per kept branch and level; ``unspecified`` when no level is known."""
    kept = branches.filter(F.col("evidence_status").isin("confirmed", "possible"))
    levels = F.when(F.size(F.coalesce("levels", F.array().cast("array<string>"))) > 0, F.col("levels")).otherwise(F.array(F.lit("unspecified")))
    rows = kept.select("branch_id", F.lit(subject).alias("subject"), F.explode(levels).alias("level"))
    return rows.withColumn("offering_id", ids.offering_id("branch_id", text.normalize_name(F.col("subject")), text.normalize_name(F.col("level"))))


def shared_addresses(branches: DataFrame) -> DataFrame:
    """Addresses claimed by more than one brand."""
    return branches.groupBy("normalized_address").agg(
        F.countDistinct("normalized_brand_name").alias("brand_count")
    ).filter("brand_count > 1")


def relocate(branches: DataFrame, relocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches with status and links, history) after applying relocations.

    ``relocations`` has previous_branch_id, new_branch_id, effective_date_known, source_ref; the
    old site becomes relocated and the new one current, and both rows stay.
    """
    distinct = F.col("previous_branch_id") != F.col("new_branch_id")
    pairs = relocations.withColumn(
        "new_branch_id", F.when(distinct, F.col("new_branch_id")).otherwise(F.raise_error(F.lit("a relocation links two branches")).cast("string"))
    )
    old = pairs.select(F.col("previous_branch_id").alias("branch_id"), F.col("new_branch_id").alias("superseded_by"))
    new = pairs.select(F.col("new_branch_id").alias("branch_id"), F.col("previous_branch_id").alias("previous_branch"))
    linked = branches.join(old, "branch_id", "left").join(new, "branch_id", "left").withColumn(
        "status",
        F.when(F.col("superseded_by").isNotNull(), "relocated").when(F.col("previous_branch").isNotNull(), "current").otherwise(F.col("status")),
    )
    history = pairs.select(
        F.col("new_branch_id").alias("branch_id"), "previous_branch_id", F.lit("relocated").alias("change_type"),
        "effective_date_known", "source_ref",
    )
    return linked, history


def status_counts(branches: DataFrame) -> DataFrame:
    """One row: current branches and distinct brands, kept apart."""
    return branches.agg(
        F.count_if(F.col("status") == "current").alias("current_branches"), F.countDistinct("brand_id").alias("distinct_brands")
    )


def geocode_decision(entities: DataFrame, responses: DataFrame, bounds: dict[str, float], *, blocked: str | None = None) -> DataFrame:
    """Exact-postal coordinate per entity from a table of search results.

    ``entities`` has entity_id and postal_code; ``responses`` has entity_id, http_status and
    results array<struct<postal, longitude, latitude>>. One distinct in-bounds coordinate resolves;
    several are ambiguous. ``blocked`` names a failure of the whole run: it applies only to
    entities that needed a lookup.
    """
    hits = responses.select("entity_id", "http_status", F.explode_outer("results").alias("r")).join(
        entities.select("entity_id", "postal_code"), "entity_id"
    )
    exact = F.trim(F.col("r.postal")) == F.col("postal_code")
    longitude, latitude = F.col("r.longitude").try_cast("double"), F.col("r.latitude").try_cast("double")
    spot = F.when(exact & longitude.isNotNull() & latitude.isNotNull(), F.struct(
        F.bround(longitude, 7).alias("longitude"), F.bround(latitude, 7).alias("latitude")
    ))
    found = hits.withColumn("_spot", F.when(F.col("http_status") == 200, spot)).groupBy("entity_id").agg(
        F.max("http_status").alias("http_status"), F.count_if(exact & (F.col("http_status") == 200)).alias("exact_count"),
        F.countDistinct("_spot").alias("coordinate_count"), F.min("_spot").alias("spot"),
    )
    lon, lat = F.col("spot.longitude"), F.col("spot.latitude")
    from areascreen.functions.numbers import in_bounds

    single = F.col("coordinate_count") == 1
    needs_lookup = _blank_to_null("postal_code").isNotNull()
    status = (
        F.when(~needs_lookup, "missing_postal_code")
        .when(F.lit(blocked is not None), F.lit(f"blocked_{blocked}"))
        .when(single & in_bounds(lon, lat, bounds), "resolved_exact_postal_unique_coordinate")
        .when(single, "out_of_bounds").when(F.col("coordinate_count") > 1, "ambiguous_exact_postal_coordinates")
        .when(F.col("http_status") == 429, "rate_limited").when(F.col("http_status") == 200, "no_exact_postal_coordinate")
        .when(F.col("http_status") > 0, "http_error").otherwise("network_error")
    )
    decided = entities.join(found, "entity_id", "left").withColumn("status", status)
    resolved = F.col("status") == "resolved_exact_postal_unique_coordinate"
    return decided.select(
        "entity_id", "status", F.when(needs_lookup, F.coalesce("exact_count", F.lit(0))).alias("exact_count"),
        F.when(needs_lookup, F.coalesce("coordinate_count", F.lit(0))).alias("coordinate_count"),
        F.when(resolved, lon).alias("longitude"), F.when(resolved, lat).alias("latitude"),
    )


def geography_policy(branches: DataFrame, selected_areas: list[str]) -> DataFrame:
    """Add planning_area_source, outcome and issue from the coordinate-derived area.

    Without a coordinate nothing is inferred; outside the selected areas the branch is
    excluded; a derived area that differs from the searched one is kept and reviewed.
    """
    derived = F.col("planning_area")
    outside = derived.isNotNull() & ~derived.isin(selected_areas)
    differs = derived.isNotNull() & ~outside & ~derived.eqNullSafe(F.col("planning_area_searched"))
    return branches.withColumns({
        "planning_area_source": F.when(derived.isNull(), "unresolved_no_coordinate").otherwise("coordinate_derived"),
        "outcome": F.when(outside, "excluded").otherwise("retained"),
        "issue_category": F.when(derived.isNull(), "planning_area_unresolved")
        .when(outside, "coordinate_derived_outside_pilot_geography")
        .when(differs, "planning_area_searched_derived_mismatch"),
    })
