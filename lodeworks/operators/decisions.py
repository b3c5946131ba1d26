"""The built-in checks as decision functions over one wide row of facts per component.

Expected columns: ``component_id, repository, tool_score, build_tools, build_commands, deploy_commands, uses, ci_text,
pipeline_run, published_before_commit, provenance, verified, verified_l3, generic_build, provenance_repo,
provenance_commit, commit, expectation_met, witness, scm_status, known_malware, malware_probability, suspicious_source,
workflow_findings, spdx, archived, deprecated, release_days, commit_days``.  Missing facts are null columns; :func:`complete`
adds those that a table lacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import checks
from lodeworks.operators.checks import BUILT_IN_GATES, FAILED, HIGH, LOW, MEDIUM, PASSED, UNKNOWN, Registry

COLUMNS = {
    "repository": "string", "tool_score": "double", "build_tools": "array<string>", "build_commands": "array<string>", "deploy_commands": "array<string>", "uses": "array<string>",
    "ci_text": "string", "pipeline_run": "string", "published_before_commit": "boolean", "provenance": "boolean", "verified": "boolean", "verified_l3": "boolean", "generic_build": "boolean",
    "provenance_repo": "string", "provenance_commit": "string", "commit": "string", "expectation_met": "boolean", "witness": "string", "scm_status": "string", "known_malware": "boolean",
    "malware_probability": "double", "suspicious_source": "boolean", "workflow_findings": "int", "spdx": "string", "archived": "boolean", "deprecated": "boolean", "release_days": "int", "commit_days": "int",
}
BUILD_WORDS = ("mvn", "gradle", "pip", "npm", "yarn", "poetry", "docker build")


def complete(facts: DataFrame) -> DataFrame:
    """The facts with null columns for those that are not there."""
    return facts.select("component_id", *[F.col(c) if c in facts.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _any_of(c: str, names: Sequence[str]) -> Column:
    return F.coalesce(F.exists(c, lambda x: F.substring_index(x, "@", 1).isin(*names)), F.lit(False)) if names else F.lit(False)


def _mentions(c: str, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.col(c).contains(w), F.lit(False))
    return out


def built_in(trusted_builders: Sequence[str] = (), trusted_deployers: Sequence[str] = (), denied_licenses: Sequence[str] = (), require_license: bool = False, stale_days: int = 365) -> Registry:
    """A registry with all built-in checks."""
    reg = Registry()

    def add(check_id: str, result: Column, confidence: Column | float = HIGH) -> None:
        deps, on_skip = BUILT_IN_GATES.get(check_id, ((), checks.SKIPPED))
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        reg.add_columns(check_id, result, conf, deps, on_skip)

    def passed(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), PASSED).otherwise(FAILED)

    add("mcn_version_control_system_1", passed(F.col("repository").isNotNull()))
    add("mcn_build_tool_1", passed(_some("build_tools")), checks.nearest_level(F.coalesce("tool_score", F.lit(0.0))))
    add("mcn_build_script_1", passed(_some("build_tools")))
    add("mcn_trusted_builder_level_three_1", passed(_any_of("uses", trusted_builders)))
    keyword = _mentions("ci_text", ("deploy", "publish"))
    as_code = _any_of("uses", trusted_deployers) | _some("deploy_commands")
    add("mcn_build_as_code_1", passed(as_code | keyword), F.when(as_code, HIGH).otherwise(LOW))
    built = _some("build_commands")
    add("mcn_build_service_1", passed(built | _mentions("ci_text", BUILD_WORDS)), F.when(built, HIGH).otherwise(LOW))
    add("mcn_find_artifact_pipeline_1", F.when(F.col("published_before_commit"), FAILED).when(F.col("pipeline_run").isNotNull(), PASSED).otherwise(FAILED), F.when(F.col("published_before_commit"), HIGH).otherwise(MEDIUM))
    add("mcn_provenance_available_1", passed(F.col("provenance")))
    level = checks.provenance_level(F.col("provenance"), F.col("verified"), F.col("verified_l3"), F.col("generic_build"))
    add("mcn_provenance_verified_1", passed(level >= 2))
    add("mcn_provenance_derived_repo_1", passed(F.col("provenance_repo") == F.col("repository")))
    add("mcn_provenance_derived_commit_1", passed(F.col("provenance_commit") == F.col("commit")))
    add("mcn_provenance_expectation_1", F.when(F.col("expectation_met").isNull(), UNKNOWN).otherwise(passed(F.col("expectation_met"))))
    add("mcn_provenance_witness_level_one_1", F.coalesce("witness", F.lit(UNKNOWN)))
    add("mcn_scm_authenticity_1", F.coalesce("scm_status", F.lit(UNKNOWN)), MEDIUM)
    bad = F.coalesce("known_malware", F.lit(False)) | (F.coalesce("malware_probability", F.lit(0.0)) > 0)
    source = F.coalesce("suspicious_source", F.lit(False))
    add("mcn_detect_malicious_metadata_1", F.when(bad | source, FAILED).otherwise(PASSED), F.when(F.col("known_malware"), HIGH).when(~bad & source, LOW).otherwise(F.coalesce("malware_probability", F.lit(HIGH))))
    add("mcn_githubactions_vulnerabilities_1", F.when(F.coalesce("workflow_findings", F.lit(0)) > 0, FAILED).otherwise(PASSED))
    lic = checks.license_decision(F.col("spdx"), tuple(denied_licenses), require_license)
    add("mcn_license_1", lic["result_type"], lic["confidence"])
    m = checks.maintainability(F.col("archived"), F.col("deprecated"), F.col("release_days"), F.col("commit_days"), stale_days)
    add("mcn_registry_maintainability_1", F.when(F.col("release_days").isNull() & F.col("archived").isNull() & F.col("deprecated").isNull(), UNKNOWN).otherwise(m["result_type"]), m["confidence"])
    return reg


def evaluate(facts: DataFrame, registry: Registry) -> DataFrame:
    """``(component_id, check_id, result_type, confidence)`` of all checks.  They are columns of one row: no join per check."""
    return registry.evaluate(complete(facts))
