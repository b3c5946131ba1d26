"""Checks: decision functions over facts, their registry, gates and summaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.urls import organisation

PASSED, FAILED, UNKNOWN, SKIPPED, DISABLED = "PASSED", "FAILED", "UNKNOWN", "SKIPPED", "DISABLED"
HIGH, MEDIUM, LOW = 1.0, 0.7, 0.4
_ID = re.compile(r"mcn_([a-z]+_)+([0-9]+)")


@dataclass(frozen=True)
class Check:
    """A check: facts in, ``(component_id, result_type, confidence)`` out."""

    check_id: str
    run: Callable[[DataFrame], DataFrame]
    #: Parent check and the result it must have.
    depends_on: tuple[tuple[str, str], ...] = ()
    on_skip: str = SKIPPED
    #: Result and confidence as columns of the facts, for checks that need nothing else.
    columns: tuple[Column, Column] | None = None


class Registry:
    """Plug-in point: checks by id, in an order in which parents come first."""

    def __init__(self) -> None:
        self.checks: dict[str, Check] = {}

    def register(self, check_id: str, depends_on: tuple[tuple[str, str], ...] = (), on_skip: str = SKIPPED):
        """Decorator for a decision function."""
        if not _ID.fullmatch(check_id):
            raise ValueError(f"{check_id} is no check id")
        if check_id in self.checks:
            raise ValueError(f"{check_id} is registered already")

        def add(run: Callable[[DataFrame], DataFrame]):
            self.checks[check_id] = Check(check_id, run, depends_on, on_skip)
            return run

        return add

    def add_columns(self, check_id: str, result: Column, confidence: Column, depends_on: tuple[tuple[str, str], ...] = (), on_skip: str = SKIPPED) -> None:
        """A check that is a column of the facts."""
        self.register(check_id, depends_on, on_skip)(lambda d: d.select("component_id", result.alias("result_type"), confidence.alias("confidence")))
        old = self.checks[check_id]
        self.checks[check_id] = Check(check_id, old.run, depends_on, on_skip, (result, confidence))

    def order(self) -> list[str]:
        """Topological order; a cycle or an unknown parent is an error."""
        done, out = set(), []
        while len(out) < len(self.checks):
            free = sorted(c for c, k in self.checks.items() if c not in done and all(p in done for p, _ in k.depends_on))
            if not free:
                raise ValueError("the checks depend on each other or on an unknown check")
            out += free
            done |= set(free)
        return out

    def evaluate(self, facts: DataFrame) -> DataFrame:
        """``(component_id, check_id, result_type, confidence)`` of all checks over wide facts, gates applied."""
        plain = {c: k.columns for c, k in self.checks.items() if k.columns}
        wide = facts.select("component_id", *[x.alias(n) for c, (r, k) in plain.items() for x, n in ((r, c), (k, f"{c}#"))])
        for c in self.order():
            k = self.checks[c]
            if c in plain:
                continue
            res = k.run(facts).select("component_id", F.col("result_type").alias(c), F.col("confidence").alias(f"{c}#"))
            wide = wide.join(res, "component_id", "left")
        wide = apply_gates(wide, {c: self.checks[c].depends_on for c in self.order()}, {c: self.checks[c].on_skip for c in self.checks})
        rows = F.array(*[F.struct(F.lit(c).alias("check_id"), F.col(c).alias("result_type"), F.col(f"{c}#").alias("confidence")) for c in self.order()])
        return wide.select("component_id", F.explode(rows).alias("r")).select("component_id", "r.*")


def apply_gates(wide: DataFrame, depends_on: dict[str, tuple[tuple[str, str], ...]], on_skip: dict[str, str]) -> DataFrame:
    """Wide results (one column per check, parents first): a check whose parent's result is another than asked reports its skip result."""
    for c, deps in depends_on.items():
        ok = F.lit(True)
        for parent, wanted in deps:
            ok = ok & (F.col(parent) == wanted)
        if deps:
            wide = wide.withColumn(c, F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(on_skip[c]))
    return wide


#: Gates of the built-in checks and what a skipped one reports (fixed values).
BUILT_IN_GATES = {
    "mcn_build_tool_1": ((("mcn_version_control_system_1", PASSED),), SKIPPED),
    "mcn_build_script_1": ((("mcn_version_control_system_1", PASSED),), FAILED),
    "mcn_trusted_builder_level_three_1": ((("mcn_version_control_system_1", PASSED),), FAILED),
    "mcn_build_as_code_1": ((("mcn_trusted_builder_level_three_1", FAILED),), PASSED),
    "mcn_build_service_1": ((("mcn_build_as_code_1", FAILED),), PASSED),
    "mcn_find_artifact_pipeline_1": ((("mcn_build_as_code_1", PASSED),), SKIPPED),
    "mcn_provenance_expectation_1": ((("mcn_provenance_available_1", PASSED),), FAILED),
    "mcn_provenance_witness_level_one_1": ((("mcn_provenance_available_1", PASSED),), FAILED),
    "mcn_githubactions_vulnerabilities_1": ((("mcn_version_control_system_1", PASSED),), SKIPPED),
}


def passed_as_bool(result: Column) -> Column:
    """True for everything but FAILED and UNKNOWN."""
    return ~result.isin(FAILED, UNKNOWN)


def status_summary(results: DataFrame, group: str | None = None, column: str = "result_type") -> DataFrame:
    """Number of results of each type, all types present."""
    kinds = [PASSED, FAILED, UNKNOWN, SKIPPED, DISABLED]
    aggs = [F.coalesce(F.sum((F.col(column) == k).cast("int")), F.lit(0)).cast("long").alias(k.lower()) for k in kinds]
    return results.groupBy(group).agg(*aggs) if group else results.agg(*aggs)


def evidence_confidence(evidence: DataFrame, key: str, weight: str, found: str) -> DataFrame:
    """``(key, score, confidence)``: the share of the weight found, to the nearest level; no weight at all is high, a tie the higher level."""
    total = F.sum(weight)
    score = F.when(total > 0, F.round(F.sum(F.when(F.col(found), F.col(weight)).otherwise(0)) / total, 6)).otherwise(1.0)
    return evidence.groupBy(key).agg(score.alias("score")).withColumn("confidence", nearest_level(F.col("score")))


def nearest_level(score: Column) -> Column:
    h, m, lo = (F.round(F.abs(score - x), 9) for x in (HIGH, MEDIUM, LOW))
    return F.when((h <= m) & (h <= lo), HIGH).when(m <= lo, MEDIUM).otherwise(LOW)


def fold_status(df: DataFrame, key: str, status: str) -> DataFrame:
    """Any PASSED is PASSED, else any FAILED is FAILED, else UNKNOWN."""
    has = lambda s: F.coalesce(F.bool_or(F.col(status) == s), F.lit(False))
    return df.groupBy(key).agg(F.when(has(PASSED), PASSED).when(has(FAILED), FAILED).otherwise(UNKNOWN).alias("result_type"))


def all_verified(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.bool_and(flag), F.lit(False)).alias("verified"))


def maintainability(archived: Column, deprecated: Column, days_since_release: Column, days_since_commit: Column, threshold: int = 365) -> Column:
    """Struct of result, reason and confidence: archived, deprecated, stale release (unless a commit is fresh), stale commit."""
    fresh, stale = days_since_commit <= threshold, days_since_commit > threshold
    reason = (
        F.when(F.coalesce(archived, F.lit(False)), "archived")
        .when(F.coalesce(deprecated, F.lit(False)), "deprecated")
        .when((days_since_release > threshold) & ~F.coalesce(fresh, F.lit(False)), "inactive")
        .when((days_since_release <= threshold) & F.coalesce(stale, F.lit(False)), "inactive")
    )
    confidence = F.when(days_since_commit.isNotNull() | deprecated.isNotNull(), HIGH).otherwise(MEDIUM)
    return F.struct(F.when(reason.isNull(), PASSED).otherwise(FAILED).alias("result_type"), reason.alias("reason"), confidence.alias("confidence"))


def license_decision(spdx: Column, denied: tuple[str, ...] = (), require: bool = False) -> Column:
    """Struct of result and confidence: a denied id fails, an unknown one only if an id is required."""
    known = spdx.isNotNull() & (spdx != "NOASSERTION")
    fails = F.when(known, spdx.isin(*denied) if denied else F.lit(False)).otherwise(F.lit(require))
    return F.struct(F.when(fails, FAILED).otherwise(PASSED).alias("result_type"), F.when(known, HIGH).otherwise(LOW).alias("confidence"))


def scm_verdict(group_id: Column, repo_owner: Column, pom_group: Column, from_provenance: Column) -> Column:
    """Does a repository belong to a package of this group?"""
    host = group_id.rlike(r"^(?:com|io|org)\.(?:github|gitlab|bitbucket)\.")
    owner = F.lower(F.element_at(F.split(organisation(group_id), r"\."), -1))
    return (
        F.when(F.coalesce(from_provenance, F.lit(False)), PASSED)
        .when(group_id.isNull(), UNKNOWN)
        .when(host & (owner == F.lower(repo_owner)), PASSED)
        .when(pom_group.isNull(), UNKNOWN)
        .when(organisation(group_id) != organisation(pom_group), FAILED)
        .otherwise(PASSED)
    )


def provenance_level(available: Column, verified: Column, verified_l3: Column, generic_build: Column) -> Column:
    """3 for a verified generic builder, 2 if verified, 1 if there is any provenance, else 0."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(available) & yes(generic_build) & yes(verified_l3), 3).when(yes(available) & yes(verified), 2).when(yes(available), 1).otherwise(0)


def witness_level(assets: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(component_id, result_type)``: every asset needs a subject of its name and digest; a subject of no asset's name leaves it open."""
    keys = ["component_id", "name"]
    foreign = subjects.join(assets.select(*keys).distinct(), keys, "left_anti").select("component_id").distinct().withColumn("foreign", F.lit(True))
    lacking = assets.join(subjects.select(*keys, "sha256").distinct(), [*keys, "sha256"], "left_anti").select("component_id").distinct().withColumn("lacking", F.lit(True))
    all_ids = assets.select("component_id").union(subjects.select("component_id")).distinct()
    return all_ids.join(foreign, "component_id", "left").join(lacking, "component_id", "left").select("component_id", F.when(F.col("foreign"), UNKNOWN).when(F.col("lacking"), FAILED).otherwise(PASSED).alias("result_type"))


def decayed_confidence(hits: DataFrame, key: str, order: str) -> DataFrame:
    """Detection confidence that halves with every further hit."""
    from pyspark.sql.window import Window

    return hits.withColumn("confidence", F.pow(F.lit(0.5), F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1))


def outermost_directories(dirs: DataFrame, key: str, path: str) -> DataFrame:
    """Directories not inside another directory of the same key."""
    d = dirs.select(key, path).distinct()
    ups = d.select(key, F.col(path).alias("_p"), F.split(path, "/").alias("_s")).select(key, "_p", F.explode(F.when(F.size("_s") > 1, F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.concat_ws("/", F.slice("_s", 1, i)))).otherwise(F.array().cast("array<string>"))).alias(path))
    nested = ups.join(d, [key, path], "left_semi").select(key, F.col("_p").alias(path))
    return d.join(nested, [key, path], "left_anti")
