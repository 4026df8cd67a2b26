"""Checks as rows: each operator returns check_id, status and what was observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from areascreen.functions.text import is_url_or_null
from areascreen.operators.skew import sized

#: Patterns of text that looks like a credential.
SECRET_PATTERNS = [
    r"(?i)authorization\s*[:=]\s*(?:bearer\s+)?[^\s,}\]]+",
    r"""(?i)["']?(?:access_token|password|api_key|secret)["']?\s*[:=]\s*["']?[^\s,"'}\]]+""",
]
_OPERATORS = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
}


def checks(df: DataFrame, tests: dict[str, tuple[Column, str]], *, table: str) -> DataFrame:
    """check_id, table_name, status, observed from one aggregate over the table.

    ``tests`` maps a check to the aggregate counting its violations and the status a violation
    has: fail or warning.
    """
    names = list(tests)
    row = df.agg(*[test.cast("bigint").alias(f"c{i}") for i, (test, _) in enumerate(tests.values())])
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("check_id"), F.lit(table).alias("table_name"),
            F.when(F.col(f"c{i}") > 0, tests[name][1]).otherwise("pass").alias("status"), F.col(f"c{i}").alias("observed"),
        )
        for i, name in enumerate(names)
    ])))


def overall_status(check_rows: DataFrame) -> DataFrame:
    """One row: failed, passed_with_warnings or passed."""
    return check_rows.agg(
        F.when(F.bool_or(F.col("status").isin("fail", "blocker")), "failed")
        .when(F.bool_or(F.col("status") == "warning"), "passed_with_warnings").otherwise("passed").alias("overall_status"),
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") != "pass").alias("not_passed"),
    )


def fail_on(check_rows: DataFrame) -> None:
    """Raise when any check failed. Check tables are small: one row per check."""
    failed = [row["check_id"] for row in check_rows.filter(F.col("status").isin("fail", "blocker")).collect()]
    if failed:
        raise ValueError(f"failed checks: {sorted(failed)}")


def threshold_gates(metrics: DataFrame, gates: Sequence[tuple[str, str, float]]) -> DataFrame:
    """gate, observed, required, status from a one-row table of metrics.

    A null metric fails. ``gates`` lists metric, comparison and bound.
    """
    rows = [
        F.struct(
            F.lit(name).alias("gate"), F.col(name).cast("double").alias("observed"), F.lit(f"{operator}{bound}").alias("required"),
            F.when(F.coalesce(_OPERATORS[operator](F.col(name), F.lit(bound)), F.lit(False)), "pass").otherwise("fail").alias("status"),
        )
        for name, operator, bound in gates
    ]
    return metrics.select(F.inline(F.array(*rows)))


def all_gates_met(gates: DataFrame) -> DataFrame:
    return gates.agg(
        F.bool_and(F.col("status") == "pass").alias("accepted"), F.count_if(F.col("status") != "pass").alias("unmet_gates")
    )


def branch_gates(branches: DataFrame, reviews: DataFrame, selected_areas: Sequence[str]) -> DataFrame:
    """gate, violations: acceptance gates over the branch and review tables.

    Needs branch_id, url, postal_code, unit, exact_address, planning_area, planning_area_source,
    evidence_status, fresh_operator_evidence, status and counts_as_primary; reviews have
    entity_reference and issue_category.
    """
    needed = branches.filter(F.col("evidence_status") != "confirmed").select(
        F.col("branch_id").cast("string").alias("entity_reference"),
        F.concat(F.lit("evidence_status_"), "evidence_status").alias("issue_category"),
    )
    undisclosed = needed.join(reviews.select("entity_reference", "issue_category").distinct(), ["entity_reference", "issue_category"], "left_anti")
    possible = F.col("evidence_status") == "possible"
    primary = F.coalesce("counts_as_primary", F.lit(False))
    derived = F.col("planning_area_source") == "coordinate_derived"
    tests = {
        "urls_valid": F.count_if(~is_url_or_null(F.col("url"))),
        "no_placeholder_branches": F.count_if(F.col("postal_code").isNull() & F.col("unit").isNull() & ~F.coalesce("exact_address", F.lit(True))),
        "planning_areas_derived_or_unresolved": F.count_if(F.col("planning_area").isNotNull() & ~F.coalesce(derived, F.lit(False))),
        "confirmed_have_fresh_evidence": F.count_if((F.col("evidence_status") == "confirmed") & ~F.coalesce("fresh_operator_evidence", F.lit(False))),
        "primary_is_confirmed_current": F.count_if(
            (primary & (F.col("evidence_status") != "confirmed")) | ((F.col("status") == "current") & ~F.col("evidence_status").isin("confirmed", "possible"))
        ),
        "possible_not_primary": F.count_if(possible & primary),
        "resolved_within_selected_areas": F.count_if(F.coalesce(derived, F.lit(False)) & ~F.coalesce(F.col("planning_area").isin(list(selected_areas)), F.lit(False))),
    }
    row = branches.agg(*[t.alias(n) for n, t in tests.items()]).withColumn(
        "review_items_enumerated", undisclosed.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("gate"), F.col(n).alias("violations")) for n in [*tests, "review_items_enumerated"]
    ])))


#: Where coordinates may come from for the geocoding gate to hold.
GEOCODING_SOURCES = ("executed", "cache")


def _rows_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def acceptance_gates(
    branches: DataFrame, reviews: DataFrame, selected_areas: Sequence[str], *, expected: DataFrame, log: DataFrame, log_errors: DataFrame,
    candidates: DataFrame, attempts: DataFrame, partition: DataFrame, integrity: DataFrame, copies: DataFrame, manifest: DataFrame,
    secrets: DataFrame, geocoding_source: str | None,
) -> DataFrame:
    """gate, violations, met: all seventeen acceptance gates of a run.

    Eight look at ``branches`` and ``reviews`` (``branch_gates``; a possible branch also needs a review that discloses it).
    The others take what other operators found: ``expected`` and ``log`` (query_id), ``log_errors`` (reconcile_log),
    ``candidates`` and ``attempts`` (candidate_id), ``partition`` (partition_report), ``integrity``
    (referential_integrity), ``copies`` (parity), ``manifest`` (verify_manifest) and ``secrets`` (summary of secret_scan).
    An empty partition, integrity, copies or secrets table does not meet its gate.
    """
    possible = branches.filter("evidence_status = 'possible'").select(F.col("branch_id").cast("string").alias("entity_reference"))
    disclosed = reviews.filter("issue_category = 'evidence_status_possible'").select("entity_reference").distinct()
    silent = possible.join(disclosed, "entity_reference", "left_anti")
    valid = lambda df, c: F.lit(1) - F.coalesce(df.agg(F.bool_and(c).cast("int").alias("ok")).scalar(), F.lit(0))
    attempted = attempts.select("candidate_id").distinct()
    run = {
        "all_queries_logged": _rows_of(expected.select("query_id").distinct().join(log.select("query_id").distinct(), "query_id", "left_anti")),
        "query_integrity_reconciled": _rows_of(log_errors),
        "validation_attempts_complete": _rows_of(candidates.select("candidate_id").distinct().join(attempted, "candidate_id", "left_anti")),
        "csv_parquet_parity": valid(copies, "equal"),
        "checksums_verify": _rows_of(manifest.filter("status != 'match'")),
        "secret_scan_pass": valid(secrets, F.col("status").isin("pass", "warning")),
        "geocoding_executed_or_validated_cache": F.lit(int(geocoding_source not in GEOCODING_SOURCES)),
        "exact_observation_provenance_partition_complete": valid(partition, "valid"),
        "retained_relational_integrity": valid(integrity, "valid"),
    }
    row = branches.sparkSession.range(1).select(*[v.cast("long").alias(n) for n, v in run.items()])
    more = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("violations")) for n in run])))
    own = branch_gates(branches, reviews, selected_areas)
    own = own.withColumn("violations", F.col("violations") + F.when(F.col("gate") == "possible_not_primary", _rows_of(silent)).otherwise(0))
    return own.unionByName(more).withColumn("met", F.col("violations") == 0)


#: Field names that a published bundle must not have.
PRIVATE_FIELDS = ("address", "postal_code", "operator_url", "email", "password", "authorization")


def release_checks(
    candidates: DataFrame, published: DataFrame, totals: DataFrame, recommendations: DataFrame, *, expected_candidates: int, key: str = "node_id",
    association_label: str = "descriptive", accepted: Sequence[str] = (),
) -> DataFrame:
    """check_id, status, observed: the checks of a release; blocker, warning or pass.

    Every frozen candidate is published once, ``totals`` (reconcile_totals) agree, published numbers are finite or null,
    no private field is published, each of ``recommendations`` (observed_count, caution_count) holds with and
    without the caution, and the association is labelled descriptive or inconclusive, never causal. ``accepted`` names
    limitations that are released as warnings.
    """
    numbers = [f.name for f in published.schema if f.dataType.typeName() in ("double", "float")]
    odd = sum(((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in numbers), F.lit(0)) if numbers else F.lit(0)
    private = [c for c in _field_names(published.schema) if c in PRIVATE_FIELDS]
    once = candidates.select(key).distinct().join(published.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "left")
    unlike = _rows_of(once.filter("_n IS NULL OR _n != 1")) + F.abs(_rows_of(candidates.select(key).distinct()) - expected_candidates)
    tests = {
        "candidates_represented": unlike,
        "totals_reconcile": _rows_of(totals.filter("status != 'pass'")),
        "numbers_finite": published.agg(F.coalesce(F.sum(F.coalesce(odd, F.lit(0))), F.lit(0)).alias("n")).scalar(),
        "no_private_fields": F.lit(len(private)),
        "recommendations_hold_both_ways": _rows_of(recommendations.filter("NOT coalesce(observed_count > 0 AND caution_count > 0, false)")),
    }
    tests["association_not_causal"] = F.lit(int(association_label not in ("descriptive", "inconclusive")))
    row = candidates.sparkSession.range(1).select(*[v.cast("long").alias(n) for n, v in tests.items()])
    rows = [F.struct(F.lit(n).alias("check_id"), F.when(F.col(n) > 0, "blocker").otherwise("pass").alias("status"), F.col(n).alias("observed")) for n in tests]
    rows += [F.struct(F.lit(n).alias("check_id"), F.lit("warning").alias("status"), F.lit(0).cast("long").alias("observed")) for n in accepted]
    return row.select(F.inline(F.array(*rows)))


def _field_names(schema) -> list[str]:
    """Names of all fields, those inside structs, arrays and maps as well."""
    found = []
    for field in getattr(schema, "fields", []):
        inner = field.dataType
        while hasattr(inner, "elementType") or hasattr(inner, "valueType"):
            inner = inner.elementType if hasattr(inner, "elementType") else inner.valueType
        found += [field.name, *_field_names(inner)]
    return found


def release_status(check_rows: DataFrame) -> DataFrame:
    """One row: blocker, pass_with_accepted_limitations or pass."""
    return check_rows.agg(
        F.when(F.bool_or(F.col("status") == "blocker"), "blocker").when(F.bool_or(F.col("status") == "warning"), "pass_with_accepted_limitations")
        .otherwise("pass").alias("release_status"), F.count_if(F.col("status") == "blocker").alias("blockers"))


def routing_plan_checks(plan: DataFrame, *, origins: DataFrame, nodes: DataFrame, scenarios: int, key: str = "od_plan_id", rows: int = 0) -> DataFrame:
    """check_id, violations: gates of a routing plan before it is executed.

    A full plan has a trip for every origin, node and scenario; ids are unique, populations and distances not negative. ``rows``
    is a bound on the plan's rows, where known: ids are told apart in partitions that follow it.
    """
    size = _rows_of(origins.select("origin_id").distinct()) * _rows_of(nodes.select("node_id").distinct()) * scenarios
    bad = {name: F.count_if(~F.coalesce(F.col(name) >= 0, F.lit(False))).alias(name) for name in ("population", "distance")}
    trips = sized(plan.select(key, "population", "distance"), [key], rows).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *bad.values())
    total = F.coalesce(F.sum("_n"), F.lit(0))
    tests = {
        "row_count": F.abs(total - size), "duplicate_trips": total - F.count(key),
        "negative_population": F.coalesce(F.sum("population"), F.lit(0)), "negative_distance": F.coalesce(F.sum("distance"), F.lit(0)),
    }
    row = trips.agg(*[t.cast("long").alias(n) for n, t in tests.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("violations")) for n in tests])))


def accessibility_checks(metrics: DataFrame, *, nodes: int, scenarios: int, cases: int) -> DataFrame:
    """check_id, violations: gates of accessibility metrics before they are published."""
    tests = {
        "row_count": F.abs(F.count(F.lit(1)) - nodes * scenarios * cases),
        "duplicate_metrics": F.count(F.lit(1)) - F.countDistinct("node_id", "scenario_id", "threshold_case_id"),
        "incomplete_routes": F.count_if(~F.coalesce("route_coverage_complete", F.lit(False))),
    }
    row = metrics.agg(*[t.cast("long").alias(n) for n, t in tests.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("violations")) for n in tests])))


def secret_scan(
    texts: DataFrame, *, path: str, content: str, credentials: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(findings, summary): texts that hold a credential pattern or a known credential value.

    Only paths and counts are reported, never matched text. ``credentials`` are the few values
    known to the caller; without them the assurance is limited.
    """
    pattern = F.lit(False)
    for p in SECRET_PATTERNS:
        pattern = pattern | F.col(content).rlike(p)
    values = F.array(*[F.lit(value) for value in credentials]).cast("array<string>")
    exact = F.exists(values, lambda value: F.contains(F.col(content), value))
    scanned = texts.select(
        path, F.coalesce(pattern, F.lit(False)).alias("generic_pattern"), F.coalesce(exact, F.lit(False)).alias("exact_value")
    )
    known = len(credentials) > 0
    found = F.col("generic_pattern") | F.col("exact_value")
    summary = scanned.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("generic_pattern").alias("pattern_findings"),
        F.count_if("exact_value").alias("exact_findings"), F.count_if(found).alias("findings"),
    ).withColumn("status", F.when(F.col("findings") > 0, "fail").otherwise("pass" if known else "warning")).withColumn(
        "assurance", F.lit("full" if known else "limited")
    )
    return scanned.filter(found), summary


def reproduce(published: DataFrame, recomputed: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """key and both values wherever a recomputed value differs from the published one."""
    a = published.select(key, *[F.col(v).alias(f"published_{v}") for v in values], F.lit(True).alias("_a"))
    b = recomputed.select(key, *[F.col(v).alias(f"recomputed_{v}") for v in values], F.lit(True).alias("_b"))
    differs = F.col("_a").isNull() | F.col("_b").isNull()
    for v in values:
        differs = differs | ~F.col(f"published_{v}").eqNullSafe(F.col(f"recomputed_{v}"))
    return a.join(b, key, "full_outer").filter(differs).drop("_a", "_b")


def reconcile_totals(totals: DataFrame, expected: dict[str, int]) -> DataFrame:
    """total, observed, expected, status for declared constants of a run (one-row ``totals``)."""
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("total"), F.col(name).cast("bigint").alias("observed"), F.lit(value).cast("bigint").alias("expected"),
            F.when(F.col(name) == value, "pass").otherwise("fail").alias("status"),
        )
        for name, value in expected.items()
    ])))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free 128-bit digest of the content."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("digest_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), *columns)).alias("digest_b"),
        F.sum(F.shiftright(F.xxhash64(F.lit("third"), *columns), 30)).alias("digest_sum"),
    )


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do two copies of a table hold the same rows?"""
    a, b = table_fingerprint(left), table_fingerprint(right)
    equal = F.lit(True)
    for c in ("rows", "digest_a", "digest_b", "digest_sum"):
        equal = equal & F.col(c).eqNullSafe(b.select(c).scalar())
    return a.select(F.col("rows").alias("left_rows"), b.select("rows").scalar().alias("right_rows"), equal.alias("equal"))
