"""Exact joins with explicit treatment of misses, duplicates and ambiguity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions.text import normalize_name
from areascreen.operators.skew import first_by, salted_join


def duplicate_keys(df: DataFrame, keys: Sequence[str], *, count: str = "copies") -> DataFrame:
    """Keys that occur more than once, with the number of occurrences."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def frequencies(df: DataFrame, keys: Sequence[str], *, count: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def exact_crosswalk(left: DataFrame, right: DataFrame, *, names: Sequence[tuple[str, str]], identifier: str) -> DataFrame:
    """Left rows with match_status matched, unmatched or ambiguous and the matched identifier.

    Names are compared after case and whitespace normalisation only. ``names`` pairs left and
    right columns. Counting before the join keeps a repeated right name from multiplying rows.
    """
    keys = [f"_k{i}" for i in range(len(names))]
    keyed_left = left.withColumns({k: normalize_name(F.col(a)) for k, (a, _) in zip(keys, names)})
    keyed_right = right.withColumns({k: normalize_name(F.col(b)) for k, (_, b) in zip(keys, names)})
    targets = keyed_right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(identifier).alias(identifier))
    joined = salted_join(keyed_left, targets, keys, spread=left.columns, how="left")
    status = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "matched").otherwise("ambiguous")
    return joined.withColumn("match_status", status).select(
        *left.columns, "match_status", F.when(F.col("_n") == 1, F.col(identifier)).alias(identifier)
    )


def never_matched(right: DataFrame, crosswalk: DataFrame, identifier: str) -> DataFrame:
    """Right rows that no left row matched."""
    return right.join(crosswalk.filter("match_status = 'matched'").select(identifier).distinct(), identifier, "left_anti")


def must_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, one-row count of left rows without a match)."""
    marked = right.withColumn("_hit", F.lit(True))
    joined = salted_join(left, marked, keys, spread=left.columns, how="left")
    misses = joined.agg(F.count_if(F.col("_hit").isNull()).alias("unmatched_rows"), F.count(F.lit(1)).alias("rows"))
    return joined.drop("_hit"), misses


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side: keys present on one side only."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    joined = a.join(b, list(keys), "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return joined.select(*keys, F.when(F.col("_a").isNull(), "unexpected").otherwise("missing").alias("side"))


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of queues in which the earliest part wins per key; other keys are all kept."""
    stacked = None
    for position, part in enumerate(parts):
        numbered = part.withColumn("_part", F.lit(position))
        stacked = numbered if stacked is None else stacked.unionByName(numbered)
    return first_by(stacked, keys, ["_part", *order]).drop("_part")


def functional_dependency(df: DataFrame, left: str, right: str) -> DataFrame:
    """direction, value, partners for values that break the one-to-one relation."""
    def broken(a: str, b: str, name: str) -> DataFrame:
        return df.groupBy(F.col(a).cast("string").alias("value")).agg(
            F.countDistinct(b).alias("partners")
        ).filter("partners > 1").select(F.lit(name).alias("direction"), "value", "partners")

    return broken(left, right, f"{left}_to_{right}").unionByName(broken(right, left, f"{right}_to_{left}"))


def partition_report(expected: DataFrame, retained: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """One row: is every expected id in exactly one of retained and excluded?"""
    seen = retained.select(key).unionByName(excluded.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(seen, key, "full_outer")
    wanted, times = F.col("_e").isNotNull(), F.coalesce("_n", F.lit(0))
    counts = joined.agg(
        F.count_if(wanted).alias("expected"), F.count_if(wanted & (times == 1)).alias("exactly_once"),
        F.count_if(wanted & (times == 0)).alias("missing"), F.count_if(times > 1).alias("duplicated"),
        F.count_if(~wanted).alias("unexpected"),
    )
    return counts.withColumn("valid", (F.col("missing") == 0) & (F.col("duplicated") == 0) & (F.col("unexpected") == 0))


def link_observations(attempts: DataFrame, *, aggregate_marker: str) -> tuple[DataFrame, DataFrame]:
    """(observation_id, attempt_id) links and observations linked more than once.

    Attempts on the marker address are brand-level and are never linked.
    """
    own = attempts.filter(F.col("address_key") != aggregate_marker)
    links = own.select("attempt_id", F.explode("source_observation_ids").alias("observation_id"))
    return links, duplicate_keys(links, ["observation_id"], count="attempts")


def branch_validations(memberships: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (branch_id, attempt_id): all validations of a branch, each once."""
    sources = memberships.select("branch_id", F.col("candidate_id").alias("observation_id"))
    return salted_join(sources, links, ["observation_id"], spread=["branch_id"]).select("branch_id", "attempt_id").distinct()


def expected_protocol(areas: DataFrame, templates: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Every area with every (channel, template, text) of a fixed protocol, with a query id.

    The protocol is a literal, so the areas are read once and never joined.
    """
    from areascreen.functions.ids import query_id

    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(t).alias("template"), F.lit(x).alias("pattern")) for c, t, x in templates
    ]))
    rows = areas.select("area_code", "area_name", each.alias("p")).select("area_code", "area_name", "p.*")
    text = F.replace("pattern", F.lit("{area}"), F.initcap("area_name"))
    return rows.withColumn("query_text", text).withColumn(
        "query_id", query_id("area_code", "channel", "template")
    ).drop("pattern")


def target_schedule(roles: DataFrame, templates: Sequence[str], precedence: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(schedule, conflicts): one role per node by precedence, times the templates.

    ``roles`` has node_id, node_name, role; a node named differently by its roles is a conflict.
    """
    position = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("role"))
    merged = roles.withColumn("_p", position).groupBy("node_id").agg(
        F.min("node_name").alias("node_name"), F.countDistinct("node_name").alias("_names"),
        F.min(F.struct("_p", "role")).alias("_first"), F.countDistinct("role").alias("role_count"),
    )
    conflicts = merged.filter("_names > 1").select("node_id", F.col("_names").alias("names"))
    schedule = merged.select(
        "node_id", "node_name", F.col("_first.role").alias("role"), "role_count",
        F.explode(F.array(*[F.lit(t) for t in templates])).alias("template"),
    )
    return schedule, conflicts


def reconcile_log(expected: DataFrame, log: DataFrame, observations: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per query: presence, field agreement and agreement of the reported with the linked counts.

    ``log`` has query_id, the fields, reported_count and zero_result; ``observations`` has query_id,
    brand_name and address_raw, and repeated signatures within one query are counted.
    """
    from areascreen.functions.text import normalize_address

    signatures = observations.groupBy(
        "query_id", normalize_name(F.col("brand_name")).alias("_b"), normalize_address(F.col("address_raw")).alias("_a")
    ).agg(F.count(F.lit(1)).alias("_n"))
    linked = signatures.groupBy("query_id").agg(
        F.sum("_n").alias("linked_count"), F.sum(F.col("_n") - 1).alias("duplicate_signatures")
    )
    a = expected.select("query_id", *[F.col(f).alias(f"_x_{f}") for f in fields], F.lit(True).alias("_expected"))
    b = log.select("query_id", *fields, "reported_count", "zero_result", F.lit(True).alias("_logged"))
    joined = a.join(b, "query_id", "full_outer").join(linked, "query_id", "left").withColumns({
        "linked_count": F.coalesce("linked_count", F.lit(0)), "duplicate_signatures": F.coalesce("duplicate_signatures", F.lit(0)),
    })
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_x_{f}"))
    logged = F.col("_logged").isNotNull()
    presence = F.when(~logged, "missing").when(F.col("_expected").isNull(), "unexpected").otherwise("present")
    return joined.select(
        "query_id", presence.alias("presence"), (logged & same).alias("fields_match"), "linked_count", "duplicate_signatures",
        F.coalesce(F.col("reported_count") == F.col("linked_count"), F.lit(False)).alias("count_reconciled"),
        F.coalesce(F.col("zero_result") == (F.col("linked_count") == 0), F.lit(False)).alias("zero_consistent"),
    )


def referential_integrity(branches: DataFrame, brands: DataFrame, evidence: DataFrame, offerings: DataFrame) -> DataFrame:
    """One row of counts: child rows without a parent and brands without a branch."""
    def orphans(child: DataFrame, parent: DataFrame, key: str) -> Column:
        return child.join(parent.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()

    row = branches.agg(F.countDistinct("branch_id").alias("branch_count"))
    counted = row.withColumns({
        "branches_without_brand": orphans(branches, brands, "brand_id"),
        "evidence_without_branch": orphans(evidence, branches, "branch_id"),
        "offerings_without_branch": orphans(offerings, branches, "branch_id"),
        "brands_without_branch": orphans(brands, branches, "brand_id"),
    })
    broken = F.col("branches_without_brand") + F.col("evidence_without_branch") + F.col("offerings_without_branch") + F.col("brands_without_branch")
    return counted.withColumn("valid", broken == 0)


def retained_only(records: DataFrame, retained: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records of the retained keys, the purged rest)."""
    keys = retained.select(key).distinct()
    return records.join(keys, key, "left_semi"), records.join(keys, key, "left_anti")


def explorer_rows(proximity: DataFrame, access: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Proximity rows with the primary accessibility and coordinates, defaults where missing."""
    return proximity.join(access, "node_id", "left").join(coordinates, "node_id", "left").na.fill(
        0, [c for c in access.columns if c != "node_id"]
    )
