"""Confirmed behaviours: what evidence is missing, how urgent it is, the queue of those to follow up, and where each one stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import missing
from corpusloom.operators.ordering import running

# Fixed values.
WEIGHTS = {
    "dynamic_code_execution": 6,
    "command_execution": 6,
    "filesystem_write": 4,
    "filesystem_delete": 4,
    "network_access": 3,
    "archive_extraction": 3,
    "external_tool_invocation": 2,
    "security_sensitive_behavior": 1,
}
EXECUTION = ("command_execution", "dynamic_code_execution")
RUNTIME = ("runtime_marker", "runtime_stub_or_monkeypatch", "local_reproduction")
DEFAULTS = ("documented_workflow", "documented_default", "default_workflow")
PROOFS = {"boundary_or_reachability": 3, "runtime_marker": 2, "runtime_stub_or_monkeypatch": 2, "source_trace": 1}


def _has(name: str) -> Column:
    return F.array_contains(F.coalesce("proofs", F.array().cast("array<string>")), name)


def _said() -> Column:
    return F.lower(F.array_join(F.coalesce("statuses", F.array().cast("array<string>")), " "))


def _open_access() -> Column:
    """No credentials were supplied: known to be so; null is not known."""
    return F.coalesce(~F.col("auth_supplied"), F.lit(False))


def missing_evidence() -> Column:
    """Names of what a row still lacks, in a fixed order; the last is never there."""
    execution = F.coalesce(F.col("category").isin(*EXECUTION), F.lit(False))
    return missing({
        "confirm_untrusted_or_cross_boundary_reachability": _has("boundary_or_reachability"),
        "confirm_authentication_authorization_boundary": F.contains(_said(), F.lit("unauthenticated")) | _open_access(),
        "add_runtime_or_stubbed_impact_observation": _has(RUNTIME[0]) | _has(RUNTIME[1]) | _has(RUNTIME[2]),
        "document_non_destructive_impact_marker_and_privilege_context": ~execution,
        "document_concrete_confidentiality_integrity_availability_impact": execution,
        "check_default_or_documented_deployment_exposure": F.exists(F.array(*map(F.lit, DEFAULTS)), lambda t: F.contains(_said(), t)),
        "prepare_private_maintainer_report_before_public_claim": F.lit(False),
    })


def score() -> Column:
    """The category's weight, points for proofs and open access, less 4 for an explicit denial. Unknown categories weigh 0."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("category")), F.lit(0))
    value = weight + 2 * _open_access().cast("int") - 4 * F.coalesce("denied", F.lit(False)).cast("int")
    for name, points in PROOFS.items():
        value = value + points * _has(name).cast("int")
    return value


def tier() -> Column:
    ready = _has("boundary_or_reachability") & (score() >= 10)
    case = F.when(F.coalesce("vulnerability", F.lit(False)), "already_vulnerability_gt").when(F.coalesce("denied", F.lit(False)), "behavior_gt_not_vulnerability")
    case = case.when(ready, "priority_boundary_impact_followup").when(F.col("category").isin(*EXECUTION), "impactful_behavior_needs_boundary_validation")
    return case.otherwise("behavior_gt_needs_additional_validation")


def upgrade_queue(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(upgrade_id, gt_id, repository, score, tier, missing): confirmed behaviours that are neither vulnerabilities nor denied, by score, then repository, then id; the first `limit` if given.

    rows(gt_id, repository, category, proofs, statuses, auth_supplied, behavior, vulnerability, denied). A null repository
    comes first, as empty. Numbers are given to the whole queue by a range-partitioned sort.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_ = rows.where(yes("behavior") & ~yes("vulnerability") & ~yes("denied")).select("gt_id", F.coalesce("repository", F.lit("")).alias("repository"), score().alias("score"), tier().alias("tier"), missing_evidence().alias("missing"))
    order = [F.desc("score"), "repository", "gt_id"]
    placed = running(open_ if limit is None else open_.orderBy(*order).limit(limit), order)
    number = (F.col("place") + 1).cast("string")
    return placed.select(F.concat(F.lit("VGU-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("upgrade_id"), "gt_id", "repository", "score", "tier", "missing")


def dispositions(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """(gt_id, disposition, basis): vulnerabilities, what the queue holds (with its tier), explicit denials (with their basis), and the rest, which is pending as well."""
    queued = queue.select("gt_id", F.col("tier").alias("_tier"))
    x = rows.join(queued, "gt_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(yes("vulnerability"), "vulnerability_gt").when(F.col("_tier").isNotNull(), "pending_upgrade_or_disclosure").when(yes("denied"), "guarded_not_vulnerability").otherwise("pending_upgrade_or_disclosure")
    basis = F.when(yes("vulnerability"), "confirmed_boundary_and_impact_reproduction").when(F.col("_tier").isNotNull(), F.col("_tier"))
    basis = basis.when(yes("denied"), F.coalesce("basis", F.lit("explicit_not_a_vulnerability_claim"))).otherwise("behavior_confirmed_but_disposition_not_explicit")
    return x.select("gt_id", kind.alias("disposition"), basis.alias("basis"))
