"""Policy evaluation: which components satisfy or violate a policy, and which policies pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Verdicts(NamedTuple):
    """The four output relations, and what they are read from: one row per policy and component, one per policy."""

    passed: DataFrame
    failed: DataFrame
    satisfies: DataFrame
    violates: DataFrame
    judged: DataFrame
    policies: DataFrame


def check_passed(check_result: DataFrame, passed: int = 1) -> DataFrame:
    """``(component_id, check_id)`` of checks with this outcome."""
    return check_result.where(F.col("passed") == passed).select("component_id", "check_id").distinct()


def checks_with_confidence(check_result: DataFrame, check_facts: DataFrame, passed: int = 1) -> DataFrame:
    """``(component_id, check_id, confidence)``."""
    cr = check_result.where(F.col("passed") == passed).select(F.col("id").alias("check_result_id"), "component_id", "check_id")
    return cr.join(check_facts.select("check_result_id", "component_id", "confidence"), ["check_result_id", "component_id"]).select("component_id", "check_id", "confidence").distinct()


def matches(column: str, pattern: str):
    """Full-string regular expression predicate."""
    return F.col(column).rlike(rf"\A(?:{pattern})\z")


def applied_analyses(analysis: DataFrame, restriction: DataFrame) -> DataFrame:
    """All analyses, or those of the restriction if it has any row."""
    none = restriction.select(F.lit(1).alias("one")).limit(1)
    free = analysis.select(F.col("id").alias("analysis_id")).withColumn("one", F.lit(1)).join(none, "one", "left_anti").select("analysis_id")
    held = analysis.select(F.col("id").alias("analysis_id")).join(restriction.select("analysis_id"), "analysis_id", "left_semi")
    return free.union(held).distinct()


def policy_applies_to(targets: DataFrame, analyses: DataFrame, component: DataFrame) -> DataFrame:
    """``(policy, component_id, purl)`` of the requirement ``targets`` whose component belongs to an analysis in scope."""
    scope = component.join(analyses, "analysis_id", "left_semi").select(F.col("id").alias("component_id"), "purl")
    return targets.select("policy", "component_id").distinct().join(scope, "component_id")


def evaluate(satisfied: DataFrame, targets: DataFrame, analyses: DataFrame, component: DataFrame) -> Verdicts:
    """Verdicts for policies satisfied by ``(policy, component_id)`` and applied to ``(policy, component_id)``.

    Every target is judged once, by one left join; the relations are read from that.
    """
    sat = satisfied.select("policy", "component_id").distinct().withColumn("_ok", F.lit(True))
    judged = policy_applies_to(targets, analyses, component).join(sat, ["policy", "component_id"], "left")
    judged = judged.select("component_id", "purl", "policy", F.coalesce("_ok", F.lit(False)).alias("satisfied"))
    policies = judged.groupBy("policy").agg(F.bool_and("satisfied").alias("passed"))
    return Verdicts(
        policies.where("passed").select("policy"), policies.where("not passed").select("policy"),
        judged.where("satisfied").drop("satisfied"), judged.where("not satisfied").drop("satisfied"), judged, policies,
    )


def exit_status(v: Verdicts) -> str:
    """``ok`` only if some policy passed and none failed."""
    if not v.failed.isEmpty():
        return "data_error"
    return "data_error" if v.passed.isEmpty() else "ok"


def template_policy(kind: str, component: DataFrame, check_result: DataFrame, purl: str, dependency_closure: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(satisfied, targets)`` of a built-in policy for components whose purl matches ``purl`` in full.

    Kinds: ``check-github-actions``, ``malware-detection`` and ``malware-detection-dependencies``, which also asks it of
    every dependency.
    """
    check = {"check-github-actions": "mcn_githubactions_vulnerabilities_1", "malware-detection": "mcn_detect_malicious_metadata_1", "malware-detection-dependencies": "mcn_detect_malicious_metadata_1"}[kind]
    targets = component.where(matches("purl", purl)).select(F.lit(kind).alias("policy"), F.col("id").alias("component_id"))
    sat = check_passed(check_result).where(F.col("check_id") == check).select("component_id")
    if kind.endswith("dependencies"):
        unsound = dependency_closure.join(sat.withColumnRenamed("component_id", "child"), "child", "left_anti").select(F.col("parent").alias("component_id"))
        sat = sat.join(unsound, "component_id", "left_anti")
    return sat.select(F.lit(kind).alias("policy"), "component_id"), targets


def non_regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(component_id)`` none of whose checks passed before and does not pass now."""
    lost = before.join(after, ["component_id", "check_id"], "left_anti").select("component_id").distinct()
    return before.select("component_id").union(after.select("component_id")).distinct().join(lost, "component_id", "left_anti")
