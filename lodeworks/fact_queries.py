"""Queries of the fact store, the policy engine, the checks and the heuristics, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions import urls, versions
from lodeworks.operators import checks, graph, heuristics, policy, relational
from lodeworks.plans import datalog
from lodeworks.session import cut
from lodeworks.sources.facts import FACTS_SQL, NOW, Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, facts: bool = True):
    """Registers a query over :class:`Facts` and its SQL, which may start with further common table expressions."""

    def add(f: Callable[[Facts], DataFrame]):
        QUERIES[name] = lambda spark, d: f(Facts(spark, d))
        if sql:
            body = sql.strip()
            ORACLES[name] = (FACTS_SQL + (", " if body.startswith("+") else " ") + body.lstrip("+").strip()) if facts else body
        return f

    return add


CLOSURE = "+ closure AS (SELECT parent, child FROM dependency UNION SELECT c.parent, d.child FROM closure c JOIN dependency d ON c.child = d.parent)"
DEEP_CLOSURE = "+ closure AS (SELECT parent, child FROM dependency_deep UNION SELECT c.parent, d.child FROM closure c JOIN dependency_deep d ON c.child = d.parent)"

# ---------------------------------------------------------------------------------------------------------------------
# Policies


def _vcs_and_build(f: Facts) -> tuple[DataFrame, DataFrame]:
    ok = policy.check_passed(f.check_result)
    both = ok.where("check_id = 'mcn_version_control_system_1'").join(ok.where("check_id = 'mcn_build_service_1'").select("component_id"), "component_id", "left_semi")
    return both.select(F.lit("vcs-and-build").alias("policy"), "component_id"), f.component.select(F.lit("vcs-and-build").alias("policy"), F.col("id").alias("component_id"))


_SAT = """+ sat AS (SELECT component_id FROM check_result WHERE passed = 1 AND check_id = 'mcn_version_control_system_1'
  INTERSECT SELECT component_id FROM check_result WHERE passed = 1 AND check_id = 'mcn_build_service_1')"""


@query("policy_component_verdicts", _SAT + """
SELECT id AS component_id, purl, 'vcs-and-build' AS policy, id IN (SELECT component_id FROM sat) AS satisfied FROM component""")
def policy_component_verdicts(f: Facts) -> DataFrame:
    sat, targets = _vcs_and_build(f)
    v = policy.evaluate(sat, targets, policy.applied_analyses(f.analysis, f.spark.createDataFrame([], "analysis_id long")), f.component)
    return v.judged


@query("policy_passed_failed", """+ p AS (SELECT DISTINCT component_id, check_id, passed FROM check_result WHERE component_id IN (SELECT id FROM component))
SELECT 'all:' || check_id AS policy, min(passed) = 1 AS passed FROM p GROUP BY check_id""")
def policy_passed_failed(f: Facts) -> DataFrame:
    name = F.concat(F.lit("all:"), "check_id").alias("policy")
    targets = f.check_result.select(name, "component_id")
    sat = f.check_result.where("passed = 1").select(name, "component_id")
    v = policy.evaluate(sat, targets, policy.applied_analyses(f.analysis, f.spark.createDataFrame([], "analysis_id long")), f.component)
    return v.policies


@query("policy_restrict_analysis", _SAT + """
SELECT id AS component_id, purl, id IN (SELECT component_id FROM sat) AS satisfied FROM component WHERE analysis_id IN (3, 7, 11)""")
def policy_restrict_analysis(f: Facts) -> DataFrame:
    sat, targets = _vcs_and_build(f)
    only = f.spark.createDataFrame([(3,), (7,), (11,)], "analysis_id long")
    v = policy.evaluate(sat, targets, policy.applied_analyses(f.analysis, only), f.component)
    return v.judged.select("component_id", "purl", "satisfied")


@query("policy_exception_list", """SELECT c.id AS component_id, c.purl FROM component c
WHERE NOT regexp_full_match(c.purl, 'pkg:(large|economy)[^/]*/.*@[1-9]')
  AND EXISTS (SELECT 1 FROM check_result r WHERE r.component_id = c.id AND r.check_id = 'mcn_build_script_1' AND r.passed = 0)""")
def policy_exception_list(f: Facts) -> DataFrame:
    excepted = f.component.where(policy.matches("purl", r"pkg:(large|economy)[^/]*/.*@[1-9]"))
    bad = policy.check_passed(f.check_result, 0).where("check_id = 'mcn_build_script_1'").select(F.col("component_id").alias("id"))
    return f.component.join(bad, "id", "left_semi").join(excepted.select("id"), "id", "left_anti").select(F.col("id").alias("component_id"), "purl")


@query("policy_non_regression", """+ lo AS (SELECT component_id, check_id FROM check_result WHERE passed = 1 AND component_id % 2 = 0),
hi AS (SELECT component_id - 1 AS component_id, check_id FROM check_result WHERE passed = 1 AND component_id % 2 = 1 AND component_id > 1)
SELECT component_id, (SELECT count(*) FROM lo WHERE lo.component_id = x.component_id AND NOT EXISTS
 (SELECT 1 FROM hi WHERE hi.component_id = lo.component_id AND hi.check_id = lo.check_id)) = 0 AS no_regression
FROM (SELECT component_id FROM lo UNION SELECT component_id FROM hi) x""")
def policy_non_regression(f: Facts) -> DataFrame:
    ok = policy.check_passed(f.check_result)
    before = ok.where("component_id % 2 = 0")
    after = ok.where("component_id % 2 = 1 and component_id > 1").withColumn("component_id", F.col("component_id") - 1)
    good = policy.non_regression(before, after).withColumn("no_regression", F.lit(True))
    every = before.select("component_id").union(after.select("component_id")).distinct()
    return every.join(good, "component_id", "left").na.fill(False, ["no_regression"])


@query("checks_with_confidence", """SELECT DISTINCT r.component_id, r.check_id, f.confidence FROM check_result r
JOIN check_facts f ON f.check_result_id = r.id AND f.component_id = r.component_id WHERE r.passed = 1""")
def checks_with_confidence(f: Facts) -> DataFrame:
    return policy.checks_with_confidence(f.check_result, f.check_facts)


@query("failed_checks_with_confidence", """SELECT DISTINCT r.component_id, r.check_id, f.confidence FROM check_result r
JOIN check_facts f ON f.check_result_id = r.id AND f.component_id = r.component_id WHERE r.passed = 0""")
def failed_checks_with_confidence(f: Facts) -> DataFrame:
    return policy.checks_with_confidence(f.check_result, f.check_facts, 0)


@query("is_check", "SELECT DISTINCT check_id FROM check_result")
def is_check(f: Facts) -> DataFrame:
    return f.check_result.select("check_id").distinct()


@query("repository_analysis", """SELECT r.id AS repository_id, r.complete_name, c.analysis_id, a.analysis_time FROM repository r
JOIN component c ON c.id = r.component_id JOIN analysis a ON a.id = c.analysis_id""")
def repository_analysis(f: Facts) -> DataFrame:
    c = f.component.select(F.col("id").alias("component_id"), "analysis_id")
    return f.repository.withColumnRenamed("id", "repository_id").join(c, "component_id").join(f.analysis.withColumnRenamed("id", "analysis_id"), "analysis_id").select("repository_id", "complete_name", "analysis_id", "analysis_time")


@query("semi_join_two_checks", """SELECT id FROM component WHERE id IN (SELECT component_id FROM check_result WHERE passed = 1 AND check_id = 'mcn_build_script_1')
AND id IN (SELECT component_id FROM check_result WHERE passed = 1 AND check_id = 'mcn_build_as_code_1')""")
def semi_join_two_checks(f: Facts) -> DataFrame:
    ok = policy.check_passed(f.check_result).withColumnRenamed("component_id", "id")
    return f.component.select("id").join(ok.where("check_id = 'mcn_build_script_1'"), "id", "left_semi").join(ok.where("check_id = 'mcn_build_as_code_1'"), "id", "left_semi")


# ---------------------------------------------------------------------------------------------------------------------
# Relational core


@query("latest_component_per_purl", """SELECT purl, id, analysis_time FROM (SELECT c.purl, c.id, a.analysis_time,
row_number() OVER (PARTITION BY c.purl ORDER BY a.analysis_time DESC, c.id DESC) AS n FROM component c JOIN analysis a ON a.id = c.analysis_id) WHERE n = 1""")
def latest_component_per_purl(f: Facts) -> DataFrame:
    return relational.latest_components(f.component, f.analysis).select("purl", "id", "analysis_time")


_TOOLS = {"build_tool": (1, "maven"), "build_as_code": (4, "gradle"), "build_service": (2, "pip"), "build_script": (3, "npm")}


def _fact_table(f: Facts, check: str, column: str) -> DataFrame:
    """Fact rows of one check: a tool name by component and a command that may be missing."""
    tool = F.when(F.col("component_id") % 3 == 0, "maven").when(F.col("component_id") % 3 == 1, "gradle").otherwise("pip")
    cmd = F.when(F.col("component_id") % 4 != 0, F.concat(F.lit('["'), tool, F.lit(' build"]')))
    return f.check_result.where(F.col("check_id") == check).select("id", tool.alias("build_tool_name"), cmd.alias(column))


for _name, _check, _col in (
    ("build_tool", "mcn_version_control_system_1", None), ("build_as_code", "mcn_build_as_code_1", "deploy_command"),
    ("build_service", "mcn_build_service_1", "build_command"), ("build_script", "mcn_build_script_1", "build_tool_command"),
):
    _where = "" if _col is None else "AND r.component_id % 4 <> 0"

    @query(f"build_facts_chain_{_name}", f"""SELECT r.component_id, c.purl, f.id, f.confidence,
CASE r.component_id % 3 WHEN 0 THEN 'maven' WHEN 1 THEN 'gradle' ELSE 'pip' END AS build_tool_name
FROM check_result r JOIN check_facts f ON f.check_result_id = r.id JOIN component c ON c.id = r.component_id WHERE r.check_id = '{_check}' {_where}""")
    def _chain(f: Facts, check: str = _check, col: str | None = _col) -> DataFrame:
        t = _fact_table(f, check, col or "command")
        out = relational.facts_chain(f.component, f.check_result, f.check_facts, t, col)
        return out.select("component_id", "purl", "id", "confidence", "build_tool_name")


def _commands(f: Facts, check: str) -> DataFrame:
    t = _fact_table(f, check, "command").where("command is not null")
    return relational.facts_chain(f.component, f.check_result, f.check_facts, t).select("id", "component_id", "build_tool_name", "confidence", "command")


@query("best_command_per_tool", """SELECT analysis_id, build_tool_name, id, confidence FROM (SELECT c.analysis_id, f.id, f.confidence,
CASE r.component_id % 3 WHEN 0 THEN 'maven' WHEN 1 THEN 'gradle' ELSE 'pip' END AS build_tool_name,
row_number() OVER (PARTITION BY c.analysis_id, r.component_id % 3 ORDER BY f.confidence DESC, f.id) AS n
FROM check_result r JOIN check_facts f ON f.check_result_id = r.id JOIN component c ON c.id = r.component_id
WHERE r.check_id = 'mcn_build_service_1' AND r.component_id % 4 <> 0) WHERE n = 1""")
def best_command_per_tool(f: Facts) -> DataFrame:
    x = _commands(f, "mcn_build_service_1").join(f.component.select(F.col("id").alias("component_id"), "analysis_id"), "component_id")
    return relational.best_command_per_tool(x, ("analysis_id", "build_tool_name")).select("analysis_id", "build_tool_name", "id", "confidence")


@query("build_command_fallback", """+ s AS (SELECT r.id, r.component_id, CASE r.check_id WHEN 'mcn_build_as_code_1' THEN 0 WHEN 'mcn_build_service_1' THEN 1 ELSE 2 END AS source_rank
FROM check_result r JOIN component c ON c.id = r.component_id
WHERE r.check_id IN ('mcn_build_as_code_1', 'mcn_build_service_1', 'mcn_build_script_1') AND r.component_id % 4 <> 0)
SELECT s.component_id, s.id, s.source_rank FROM s JOIN (SELECT component_id, min(source_rank) AS m FROM s GROUP BY 1) b ON b.component_id = s.component_id AND b.m = s.source_rank""")
def build_command_fallback(f: Facts) -> DataFrame:
    return relational.fallback_chain([_commands(f, c) for c in ("mcn_build_as_code_1", "mcn_build_service_1", "mcn_build_script_1")], "component_id").select("component_id", "id", "source_rank")


@query("failed_check_diagnostics", """SELECT c.id AS component_id, c.purl, r.check_id, f.confidence, a.analysis_time FROM check_facts f JOIN check_result r ON f.check_result_id = r.id
JOIN component c ON r.component_id = c.id JOIN analysis a ON c.analysis_id = a.id WHERE r.passed = 0""")
def failed_check_diagnostics(f: Facts) -> DataFrame:
    return relational.failed_diagnostics(f.component, f.analysis, f.check_result, f.check_facts).select("component_id", "purl", "check_id", "confidence", "analysis_time")


_FINDINGS = "+ findings AS (SELECT id, component_id, check_id, CAST(20 + (id * 37) % 80 AS INTEGER) AS priority FROM check_result WHERE passed = 0)"


def _findings(f: Facts) -> DataFrame:
    return f.check_result.where("passed = 0").select("id", "component_id", "check_id", (20 + (F.col("id") * 37) % 80).cast("int").alias("priority"))


_BUCKET = "CASE WHEN priority >= 90 THEN 'critical' WHEN priority >= 70 THEN 'high' WHEN priority >= 50 THEN 'medium' ELSE 'low' END AS bucket"


@query("top_findings_global", _FINDINGS + f" SELECT id, priority, {_BUCKET} FROM findings ORDER BY priority DESC, id LIMIT 10")
def top_findings_global(f: Facts) -> DataFrame:
    return _findings(f).orderBy(F.col("priority").desc(), "id").limit(10).select("id", "priority", relational.priority_bucket(F.col("priority")).alias("bucket"))


@query("top_findings_per_group", _FINDINGS + f" SELECT check_id, id, priority, {_BUCKET} FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY priority DESC, id) AS n FROM findings) WHERE n <= 10")
def top_findings_per_group(f: Facts) -> DataFrame:
    return relational.first_per_group(_findings(f), ["check_id"], [F.col("priority").desc(), F.col("id")], 10).select("check_id", "id", "priority", relational.priority_bucket(F.col("priority")).alias("bucket"))


@query("component_attributes", """SELECT id, attribute, value FROM (SELECT id, purl, CAST(analysis_id AS VARCHAR) AS analysis_id, type, name, version FROM component)
UNPIVOT (value FOR attribute IN (purl, analysis_id, type, name, version))""")
def component_attributes(f: Facts) -> DataFrame:
    return relational.attributes(f.component, ["id"])


@query("fk_attributes", """SELECT r.id, x.attribute, x.value FROM repository r JOIN (SELECT id, attribute, value FROM (SELECT id, purl, type FROM component)
UNPIVOT (value FOR attribute IN (purl, type))) x ON x.id = r.component_id""")
def fk_attributes(f: Facts) -> DataFrame:
    return relational.foreign_attributes(f.repository, "id", "component_id", f.component, "id", ["purl", "type"])


@query("fk_attributes_parity", """SELECT n.id, x.attribute, x.value FROM analysis n CROSS JOIN (SELECT DISTINCT 'r_name' AS attribute, r_name AS value FROM region) x""")
def fk_attributes_parity(f: Facts) -> DataFrame:
    return relational.foreign_attributes(f.analysis, "id", "id", f.table("region"), "r_regionkey", ["r_name"], parity=True)


@query("stronger_confidence", """SELECT component_id, strong, weak FROM (SELECT r.component_id, max(f.confidence) FILTER (r.check_id = 'mcn_build_as_code_1') AS strong,
min(f.confidence) FILTER (r.check_id = 'mcn_build_script_1') AS weak FROM check_result r JOIN check_facts f ON f.check_result_id = r.id GROUP BY 1) WHERE strong > weak""")
def stronger_confidence(f: Facts) -> DataFrame:
    x = policy.checks_with_confidence(f.check_result, f.check_facts).unionByName(policy.checks_with_confidence(f.check_result, f.check_facts, 0))
    return relational.stronger_confidence(x, "component_id", "check_id", "mcn_build_as_code_1", "mcn_build_script_1")


@query("common_purl", """SELECT analysis_id, CASE WHEN count(DISTINCT type) = 1 THEN min(type) END AS type, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END AS name,
CASE WHEN count(DISTINCT version) = 1 THEN min(version) END AS version FROM component GROUP BY 1""")
def common_purl(f: Facts) -> DataFrame:
    return relational.common_purl(f.component, "analysis_id")


@query("max_component_per_purl", "SELECT purl, max(id) AS id FROM component GROUP BY purl")
def max_component_per_purl(f: Facts) -> DataFrame:
    return f.component.groupBy("purl").agg(F.max("id").alias("id"))


@query("running_max_confidence", """SELECT r.component_id, f.id, f.confidence, max(f.confidence) OVER (PARTITION BY r.component_id ORDER BY f.id) AS best_so_far
FROM check_result r JOIN check_facts f ON f.check_result_id = r.id""")
def running_max_confidence(f: Facts) -> DataFrame:
    w = Window.partitionBy("component_id").orderBy("id")
    return f.check_facts.select("component_id", "id", "confidence", F.max("confidence").over(w).alias("best_so_far"))


@query("justification", """SELECT id, CASE WHEN purl IS NULL AND version IS NULL THEN ['Not Available.'] ELSE list_filter(['TEXT:version=' || version, 'HREF:purl=' || purl], lambda x: x IS NOT NULL) END AS justification FROM component""")
def justification(f: Facts) -> DataFrame:
    return f.component.select("id", relational.justification({"version": "TEXT", "purl": "HREF"}).alias("justification"))


@query("dropped_checks", "SELECT check_id FROM check_result EXCEPT SELECT check_id FROM check_result WHERE passed = 0")
def dropped_checks(f: Facts) -> DataFrame:
    return f.check_result.select("check_id").subtract(f.check_result.where("passed = 0").select("check_id"))


# ---------------------------------------------------------------------------------------------------------------------
# Recursion


@query("transitive_dependency", CLOSURE + " SELECT parent, child FROM closure")
def transitive_dependency(f: Facts) -> DataFrame:
    return graph.transitive_closure(f.dependency)


@query("transitive_dependency_deep", DEEP_CLOSURE + " SELECT parent, child FROM closure")
def transitive_dependency_deep(f: Facts) -> DataFrame:
    return graph.transitive_closure(f.dependency_deep)


@query("reachable_from", DEEP_CLOSURE + ", most AS (SELECT max(id) AS m FROM component) SELECT child AS node FROM closure, most WHERE parent = m UNION SELECT m FROM most")
def reachable_from(f: Facts) -> DataFrame:
    return graph.reachable(f.dependency_deep, f.component.agg(F.max("id").alias("node"))).select("node")


@query("topological_levels", """+ depth AS (SELECT id AS node, 0 AS level FROM component WHERE id NOT IN (SELECT child FROM dependency)
UNION SELECT d.child, x.level + 1 FROM depth x JOIN dependency d ON d.parent = x.node)
SELECT node, max(level) AS level FROM depth WHERE node IN (SELECT parent FROM dependency UNION SELECT child FROM dependency) GROUP BY 1""")
def topological_levels(f: Facts) -> DataFrame:
    return graph.topological_levels(f.dependency)


#: A small check graph and its selection patterns.
_CHECK_EDGES = [("mcn_vcs", "mcn_tool"), ("mcn_vcs", "mcn_script"), ("mcn_vcs", "mcn_trusted"), ("mcn_trusted", "mcn_as_code"), ("mcn_as_code", "mcn_service"), ("mcn_as_code", "mcn_pipeline"), ("mcn_available", "mcn_expectation"), ("mcn_available", "mcn_witness")]
_EDGE_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _CHECK_EDGES)


@query("check_selection_closure", f"""WITH RECURSIVE e(parent, child) AS (VALUES {_EDGE_VALUES}), n AS (SELECT parent AS node FROM e UNION SELECT child FROM e),
up AS (SELECT node FROM n WHERE node LIKE 'mcn\\_%s%' ESCAPE '\\' UNION SELECT e.parent FROM up JOIN e ON e.child = up.node),
down AS (SELECT node FROM n WHERE node = 'mcn_pipeline' OR node LIKE '%witness' UNION SELECT e.child FROM down JOIN e ON e.parent = down.node)
SELECT node FROM up EXCEPT SELECT node FROM down""", facts=False)
def check_selection_closure(f: Facts) -> DataFrame:
    e = f.spark.createDataFrame(_CHECK_EDGES, "parent string, child string")
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    return graph.selection_closure(e, nodes, ["mcn_*s*"], ["mcn_pipeline", "*witness"])


@query("violating_dependencies", CLOSURE + """ SELECT DISTINCT c.parent, c.child FROM closure c WHERE NOT EXISTS
(SELECT 1 FROM check_result r WHERE r.component_id = c.child AND r.check_id = 'mcn_version_control_system_1' AND r.passed = 1)""")
def violating_dependencies(f: Facts) -> DataFrame:
    ok = policy.check_passed(f.check_result).where("check_id = 'mcn_version_control_system_1'").select(F.col("component_id").alias("child"))
    return graph.transitive_closure(f.dependency).join(ok, "child", "left_anti").select("parent", "child")


@query("transitive_policy", CLOSURE + """, bad AS (SELECT c.parent FROM closure c WHERE NOT EXISTS
(SELECT 1 FROM check_result r WHERE r.component_id = c.child AND r.check_id = 'mcn_build_service_1' AND r.passed = 1))
SELECT c.id AS component_id FROM component c WHERE c.id NOT IN (SELECT parent FROM bad)
AND EXISTS (SELECT 1 FROM check_result r WHERE r.component_id = c.id AND r.check_id = 'mcn_build_service_1' AND r.passed = 1)""")
def transitive_policy(f: Facts) -> DataFrame:
    ok = policy.check_passed(f.check_result).where("check_id = 'mcn_build_service_1'").select("component_id")
    bad = graph.transitive_closure(f.dependency).join(ok.withColumnRenamed("component_id", "child"), "child", "left_anti").select(F.col("parent").alias("component_id"))
    return ok.join(f.component.select(F.col("id").alias("component_id")), "component_id", "left_semi").join(bad, "component_id", "left_anti")


_OWN = """, got AS (SELECT component_id, list(DISTINCT check_id) AS l FROM check_result WHERE passed = 1 GROUP BY 1),
l1 AS (SELECT component_id FROM got WHERE list_has_all(l, ['mcn_version_control_system_1', 'mcn_build_service_1', 'mcn_build_script_1'])),
own AS (SELECT c.id, CASE WHEN l1.component_id IS NULL THEN 0 WHEN NOT list_has_all(l, ['mcn_build_as_code_1']) THEN 1
WHEN NOT list_has_all(l, ['mcn_trusted_builder_level_three_1', 'mcn_provenance_level_three_1']) THEN 2
WHEN NOT list_has_all(l, ['mcn_provenance_expectation_1']) THEN 3 ELSE 4 END AS own_level
FROM component c LEFT JOIN l1 ON l1.component_id = c.id LEFT JOIN got ON got.component_id = c.id),
weak AS (SELECT parent, min(own_level) AS w FROM closure JOIN own ON own.id = closure.child GROUP BY 1),
lv AS (SELECT own.id, own_level, (SELECT max(l) FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 2), (4, 4)) t(l, need)
WHERE own_level >= l AND coalesce(w, 9) >= need) AS level FROM own LEFT JOIN weak ON weak.parent = own.id)"""


@query("aggregate_level", CLOSURE + _OWN + " SELECT id, own_level, level FROM lv")
def aggregate_level(f: Facts) -> DataFrame:
    return graph.aggregate_levels(f.component, f.dependency, f.check_result)


@query("meets_level", CLOSURE + _OWN + " SELECT id, unnest(range(0, level + 1)) AS level FROM lv")
def meets_level(f: Facts) -> DataFrame:
    return graph.levels_met(graph.aggregate_levels(f.component, f.dependency, f.check_result))


# ---------------------------------------------------------------------------------------------------------------------
# Rule programs


def _engine(f: Facts) -> datalog.Engine:
    r = {
        "analysis": f.analysis.select("id", "analysis_time"),
        "component": f.component.select("id", "purl", "analysis_id"),
        "dependency": f.dependency.select("parent", "child"),
        "check_result": f.check_result.select("id", "check_id", "passed", "component_id"),
        "check_facts": f.check_facts.select("id", "confidence", "component_id", "check_result_id"),
    }
    return datalog.Engine(f.spark, r)


@query("rules_policy_verdicts", _SAT + """
SELECT id AS component, purl, 'p1' AS policy FROM component WHERE id IN (SELECT component_id FROM sat) AND regexp_full_match(purl, 'pkg:(small|medium).*')""")
def rules_policy_verdicts(f: Facts) -> DataFrame:
    text = """
    #define WANTED "pkg:(small|medium).*"
    Policy("p1", c, "built") :- check_passed(c, "mcn_version_control_system_1"), check_passed(c, "mcn_build_service_1").
    apply_policy_to("p1", c) :- component(c, purl, _), match(WANTED, purl).
    """
    return datalog.run_policies(_engine(f), text)["component_satisfies_policy"]


@query("rules_restricted_analysis", _SAT + """
SELECT id AS component, purl, 'p1' AS policy FROM component WHERE analysis_id IN (3, 7, 11) AND id NOT IN (SELECT component_id FROM sat)""")
def rules_restricted_analysis(f: Facts) -> DataFrame:
    text = """
    restrict_to_analysis(a) :- analysis(a, _), listed(a).
    .decl listed(a: number)
    listed(3). listed(7). listed(11).
    Policy("p1", c, "built") :- check_passed(c, "mcn_version_control_system_1"), check_passed(c, "mcn_build_service_1").
    apply_policy_to("p1", c) :- component(c, _, a), apply_to_analysis(a).
    """
    return datalog.run_policies(_engine(f), text)["component_violates_policy"]


@query("rules_subsumption_min", CLOSURE + """ SELECT parent AS component, min(f.confidence) AS least FROM closure c JOIN check_facts f ON f.component_id = c.child GROUP BY 1""")
def rules_subsumption_min(f: Facts) -> DataFrame:
    text = """
    .decl least(component: number, least: float)
    least(p, f) :- transitive_dependency(p, c), check_facts(_, f, c, _).
    least(c, a) <= least(c, b) :- b <= a.
    .output least
    """
    return datalog.run_policies(_engine(f), text)["least"]


@query("rules_unrelated_atoms", """+ v AS (SELECT DISTINCT component_id FROM check_result WHERE passed = 1 AND check_id = 'mcn_build_service_1') SELECT r.r_name AS region, v.component_id AS component FROM region r, v WHERE v.component_id <= 40""")
def rules_unrelated_atoms(f: Facts) -> DataFrame:
    e = _engine(f)
    e.relations["region"] = datalog.Engine._positional(f.table("region").select("r_name"))
    text = """
    .decl both(region: symbol, component: number)
    both(r, c) :- region(r), check_passed(c, "mcn_build_service_1"), c <= 40.
    .output both
    """
    return datalog.run_policies(e, text)["both"]


@query("rules_exception_and_closure", CLOSURE + """ SELECT DISTINCT c.parent AS component FROM closure c JOIN component p ON p.id = c.parent
WHERE NOT EXISTS (SELECT 1 FROM check_result r WHERE r.component_id = c.child AND r.check_id = 'mcn_build_script_1' AND r.passed = 1)
AND p.purl NOT IN (SELECT purl FROM component WHERE id % 7 = 0)""")
def rules_exception_and_closure(f: Facts) -> DataFrame:
    text = """
    .decl check_passed(c: number, n: symbol)
    check_passed(c, n) :- check_result(_, n, 1, c).
    .decl path(a: number, b: number)
    path(a, b) :- dependency(a, b).
    path(a, c) :- path(a, b), dependency(b, c).
    .decl excepted(purl: symbol)
    excepted(p) :- component(id, p, _), id % 7 = 0.
    violating(p) :- path(p, c), !check_passed(c, "mcn_build_script_1"), component(p, purl, _), !excepted(purl).
    .decl violating(component: number)
    .output violating
    """
    return _engine(f).run(text)["violating"]


@query("rules_count_aggregate", """SELECT c.id AS component, (SELECT count(*) FROM (SELECT DISTINCT r.check_id FROM check_result r WHERE r.component_id = c.id AND r.passed = 1)) AS n FROM component c""")
def rules_count_aggregate(f: Facts) -> DataFrame:
    text = """
    .decl passed(c: number, n: symbol)
    passed(c, n) :- check_result(_, n, 1, c).
    .decl total(component: number, n: number)
    total(c, n) :- component(c, _, _), n = count : { passed(c, _x) }.
    .output total
    """
    return _engine(f).run(text)["total"]


@query("rules_subsumption_max", """SELECT component_id AS component, max(confidence) AS best FROM check_facts GROUP BY 1""")
def rules_subsumption_max(f: Facts) -> DataFrame:
    text = """
    .decl best(component: number, best: float)
    best(c, f) :- check_facts(_, f, c, _).
    best(c, a) <= best(c, b) :- a <= b.
    .output best
    """
    return _engine(f).run(text)["best"]


# ---------------------------------------------------------------------------------------------------------------------
# Versions, intervals, addresses


@query("vulnerable_range_join", """+ x AS (SELECT a.adv_num, u.a.package.name AS package, u.a.package.ecosystem AS ecosystem, unnest(u.a.ranges) AS r FROM advisories a, (SELECT adv_num AS k, unnest(affected) AS a FROM advisories) u WHERE u.k = a.adv_num AND u.a.package.name IS NOT NULL),
e AS (SELECT adv_num, package, ecosystem, list_filter(list_transform(r.events, lambda t: t.introduced), lambda t: t IS NOT NULL)[-1] AS lo, list_filter(list_transform(r.events, lambda t: t.fixed), lambda t: t IS NOT NULL)[-1] AS hi FROM x WHERE len(r.events) > 0),
k AS (SELECT adv_num, package, ecosystem, list_transform(string_split(coalesce(lo, '0'), '.'), lambda t: CAST(t AS BIGINT)) AS lo,
CASE WHEN hi IS NOT NULL THEN list_transform(string_split(hi, '.'), lambda t: CAST(t AS BIGINT)) END AS hi FROM e),
v AS (SELECT DISTINCT package, ecosystem, s.version FROM k CROSS JOIN (VALUES ('0.9'), ('2.1.0'), ('5.0.0'), ('8.4.1')) s(version)),
w AS (SELECT *, list_transform(string_split(version, '.'), lambda t: CAST(t AS BIGINT)) AS ver FROM v),
p AS (SELECT w.package, w.version, k.adv_num AS adv, list_resize(w.ver, 6, 0) AS a, list_resize(k.lo, 6, 0) AS b, CASE WHEN hi IS NOT NULL THEN list_resize(k.hi, 6, 0) END AS c FROM w JOIN k USING (package, ecosystem))
SELECT DISTINCT package, version, adv FROM p WHERE a >= b AND (c IS NULL OR a < c)""")
def vulnerable_range_join(f: Facts) -> DataFrame:
    adv = f.table("advisories").select(F.col("adv_num").alias("adv"), "affected")
    names = adv.select(F.explode("affected").alias("a")).select(F.col("a.package.name").alias("package"), F.col("a.package.ecosystem").alias("ecosystem")).where("package is not null").distinct()
    packages = names.withColumn("version", F.explode(F.array(*map(F.lit, ("0.9", "2.1.0", "5.0.0", "8.4.1")))))
    return versions.vulnerable(packages, adv)


WINDOW_S = 6 * 3600


@query("ci_run_interval_match", f"""SELECT p.package, p.seq, r.run_id, r.started_at + INTERVAL 400 DAY < TIMESTAMP '{NOW}' AS expired
FROM releases p JOIN ci_runs r ON r.package = p.package AND r.started_at < p.upload_time AND r.started_at >= p.upload_time - INTERVAL {WINDOW_S} SECOND""")
def ci_run_interval_match(f: Facts) -> DataFrame:
    m = relational.ci_runs_before_publish(f.ci_runs, f.releases, WINDOW_S)
    return relational.with_retention(m, "started_at", NOW).select("package", "seq", "run_id", "expired")


@query("first_run_per_release", f"""SELECT package, seq, run_id FROM (SELECT p.package, p.seq, r.run_id, row_number() OVER (PARTITION BY p.package, p.seq ORDER BY r.started_at DESC, r.run_id) AS n
FROM releases p JOIN ci_runs r ON r.package = p.package AND r.started_at < p.upload_time AND r.started_at >= p.upload_time - INTERVAL {WINDOW_S} SECOND) WHERE n = 1""")
def first_run_per_release(f: Facts) -> DataFrame:
    m = relational.ci_runs_before_publish(f.ci_runs, f.releases, WINDOW_S)
    return relational.first_per_group(m, ["package", "seq"], [F.col("started_at").desc(), F.col("run_id")]).select("package", "seq", "run_id")


@query("highest_tag", """SELECT package_name, max(list_resize(list_transform(string_split(release_version, '.'), lambda t: CAST(t AS BIGINT)), 6, 0)) AS k FROM release_files GROUP BY 1
HAVING k > [0, 0, 0, 0, 0, 0]""", facts=False)
def highest_tag(f: Facts) -> DataFrame:
    best = versions.highest_tag(f.table("release_files"), "package_name", "release_version")
    parts = F.transform(F.split("release_version", r"\."), lambda x: x.try_cast("bigint"))
    return best.select("package_name", F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 6)), 1, 6).alias("k"))


@query("latest_dependency_dedup", """+ d AS (SELECT c.id, c.name, CAST(c.version AS BIGINT) AS v, r.remote_path AS url FROM component c LEFT JOIN repository r ON r.component_id = c.id % 10 + 1),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v DESC, id DESC) AS n FROM d)
SELECT name, id, url, row_number() OVER (PARTITION BY url ORDER BY id) > 1 AS duplicate FROM b WHERE n = 1""")
def latest_dependency_dedup(f: Facts) -> DataFrame:
    r = f.repository.select(F.col("component_id").alias("k"), F.col("remote_path").alias("url"))
    d = f.component.select("id", "name", "version", (F.col("id") % 10 + 1).alias("k")).join(r, "k", "left")
    best = relational.first_per_group(d, ["name"], [versions.version_key(F.col("version")).desc(), F.col("id").desc()])
    return best.select("name", "id", "url", (F.row_number().over(Window.partitionBy("url").orderBy("id")) > 1).alias("duplicate"))


@query("purl_parse", r"""SELECT id, regexp_extract(purl, '^pkg:([^/]+)/', 1) AS type, regexp_extract(purl, '^pkg:[^/]+/([^@]+)@', 1) AS name, regexp_extract(purl, '@(.+)$', 1) AS version FROM component WHERE purl NOT LIKE 'pkg:% %'""")
def purl_parse(f: Facts) -> DataFrame:
    return f.component.where("purl not like 'pkg:% %'").select("id", urls.parse_purl(F.col("purl")).alias("p")).select("id", "p.type", "p.name", "p.version")


@query("url_normalize", """SELECT id, 'https://' || complete_name AS remote, regexp_extract(complete_name, '^[^/]+/(.*)$', 1) AS full_name FROM repository""")
def url_normalize(f: Facts) -> DataFrame:
    forms = F.when(F.col("id") % 4 == 0, F.concat(F.lit("git@"), F.regexp_replace("complete_name", "^github.com/", "github.com:"), F.lit(".git"))).when(F.col("id") % 4 == 1, F.concat(F.lit("ssh://git@"), F.regexp_replace("complete_name", "^github.com/", "github.com:7999/"))).when(F.col("id") % 4 == 2, F.concat(F.lit("git+https://"), "complete_name", F.lit(".git"))).otherwise(F.concat(F.lit("scm:git:https://"), "complete_name", F.lit("/tree/main")))
    remote = urls.remote_url(forms)
    return f.repository.select("id", remote.alias("remote"), urls.full_name(remote).alias("full_name"))


@query("repo_url_equiv", """SELECT a.id AS left_id, b.id AS right_id FROM repository a JOIN repository b ON a.complete_name = b.complete_name""")
def repo_url_equiv(f: Facts) -> DataFrame:
    a = f.repository.select(F.col("id").alias("left_id"), urls.same_repository_key(F.concat("remote_path", F.lit(".git"))).alias("k"))
    b = f.repository.select(F.col("id").alias("right_id"), urls.same_repository_key(F.concat(F.lit("ssh://git@"), "complete_name", F.lit("/"))).alias("k"))
    return a.join(b, "k").select("left_id", "right_id")


_EDGE = r"""[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"''()<>\[\]{},;!]+"""
_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


@query("same_org", rf"""WITH b AS (SELECT DISTINCT group_name, regexp_replace(regexp_replace(lower(group_name), '^{_EDGE}', ''), '{_EDGE}$', '') AS s FROM bom_components WHERE group_name IS NOT NULL),
l AS (SELECT group_name, list_filter(string_split_regex(s, '{_WHITE}\.{_WHITE}'), lambda x: x <> '') AS l FROM b)
SELECT group_name, array_to_string(list_slice(l, 1, CASE WHEN array_to_string(list_slice(l, 1, 2), '.') IN ('com.github', 'io.github', 'org.github', 'com.gitlab', 'io.gitlab', 'org.gitlab', 'com.bitbucket', 'io.bitbucket', 'org.bitbucket') THEN 3 ELSE 2 END), '.') AS organisation FROM l""", facts=False)
def same_org(f: Facts) -> DataFrame:
    g = f.table("bom_components").where("group_name is not null").select("group_name").distinct()
    return g.select("group_name", urls.organisation(F.col("group_name")).alias("organisation"))


@query("complete_name_parts", "SELECT id, split_part(complete_name, '/', 1) AS type, split_part(complete_name, '/', 2) AS owner, split_part(complete_name, '/', 3) AS name FROM repository")
def complete_name_parts(f: Facts) -> DataFrame:
    return f.repository.select("id", urls.complete_name_parts(F.col("complete_name")).alias("p")).select("id", "p.*")


@query("sanitised_path", r"SELECT id, regexp_replace(type, '[^A-Za-z0-9-]', '_', 'g') || '/' || regexp_replace(name, '[^A-Za-z0-9-]', '_', 'g') AS path FROM component WHERE purl NOT LIKE 'pkg:% %'")
def sanitised_path(f: Facts) -> DataFrame:
    return f.component.where("purl not like 'pkg:% %'").select("id", urls.purl_path(F.col("purl")).alias("path"))


# ---------------------------------------------------------------------------------------------------------------------
# Evidence, heuristics


@query("evidence_confidence", """+ e AS (SELECT l_partkey AS k, sum(l_quantity) AS total, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS found FROM lineitem GROUP BY 1),
s AS (SELECT k, CASE WHEN total > 0 THEN round(found / total, 6) ELSE 1.0 END AS score FROM e)
SELECT k AS component_id, score, CASE WHEN round(abs(score - 1.0), 9) <= round(abs(score - 0.7), 9) AND round(abs(score - 1.0), 9) <= round(abs(score - 0.4), 9) THEN 1.0
WHEN round(abs(score - 0.7), 9) <= round(abs(score - 0.4), 9) THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM s""")
def evidence_confidence(f: Facts) -> DataFrame:
    e = f.table("lineitem").select(F.col("l_partkey").alias("component_id"), F.col("l_quantity").alias("w"), (F.col("l_returnflag") == "R").alias("found"))
    return checks.evidence_confidence(e, "component_id", "w", "found")


@query("noisy_or", """SELECT component_id, round(1 - product(1 - confidence * 0.3), 6) AS probability FROM check_facts GROUP BY 1""")
def noisy_or(f: Facts) -> DataFrame:
    return heuristics.noisy_or(f.check_facts.withColumn("p", F.col("confidence") * 0.3), "component_id", "p")


_SLOTS = {"one_release": 1, "high_release_frequency": 2, "empty_project_link": 3, "closer_release_join_date": 4, "suspicious_setup": 5, "wheel_absence": 6, "unchanged_release": 7}


@query("malware_rule_probability", "+ h AS (SELECT component_id, " + ", ".join(
    f"max(CASE WHEN (id - component_id * 7) = {n} THEN CASE passed WHEN 1 THEN 'PASS' ELSE 'FAIL' END END) AS h{n}" for n in range(1, 8)) + """ FROM check_result GROUP BY 1),
r AS (SELECT component_id, (h3 = 'FAIL' AND h4 = 'FAIL') AS quick, (h5 = 'FAIL' AND h6 = 'FAIL') AS forced, h1, h2, h5, h7 FROM h)
SELECT component_id, round(1 - (1 - CASE WHEN quick AND forced AND h1 = 'FAIL' THEN 1.0 ELSE 0.0 END) * (1 - CASE WHEN quick AND forced AND h2 = 'FAIL' THEN 1.0 ELSE 0.0 END)
* (1 - CASE WHEN quick AND h2 = 'FAIL' AND h7 = 'FAIL' AND h5 = 'PASS' THEN 0.7 ELSE 0.0 END), 6)::DOUBLE AS probability FROM r""")
def malware_rule_probability(f: Facts) -> DataFrame:
    slot = F.col("id") - F.col("component_id") * 7
    name = F.coalesce(*[F.when(slot == n, h) for h, n in _SLOTS.items()])
    long = f.check_result.select("component_id", name.alias("heuristic"), F.when(F.col("passed") == 1, "PASS").otherwise("FAIL").alias("result"))
    return heuristics.rule_probability(heuristics.widen(long, "component_id", heuristics.rule_names()), "component_id").select("component_id", "probability")


@query("release_cadence", """+ g AS (SELECT package, abs(date_diff('second', lag(upload_time) OVER (PARTITION BY package ORDER BY seq), upload_time)) // 86400 AS gap FROM releases)
SELECT package, count(*) AS n_releases, CASE WHEN count(*) > 1 THEN CAST(sum(gap) AS BIGINT) // (count(*) - 1) END AS mean_gap,
CASE WHEN count(*) < 2 THEN 'SKIP' WHEN CAST(sum(gap) AS BIGINT) // (count(*) - 1) <= 2 THEN 'FAIL' ELSE 'PASS' END AS result FROM g GROUP BY 1""")
def release_cadence(f: Facts) -> DataFrame:
    g = heuristics.release_gaps(f.releases)
    return g.withColumn("result", heuristics.high_release_frequency(F.col("mean_gap")))


@query("unchanged_release", "SELECT package, CASE WHEN count(*) > count(DISTINCT digest) THEN 'FAIL' ELSE 'PASS' END AS result FROM releases GROUP BY 1")
def unchanged_release(f: Facts) -> DataFrame:
    return heuristics.unchanged_release(f.releases)


@query("one_release", "SELECT c.c_custkey AS package, CASE WHEN n IS NULL THEN 'SKIP' WHEN n = 1 THEN 'FAIL' ELSE 'PASS' END AS result FROM customer c LEFT JOIN (SELECT package, count(*) AS n FROM releases GROUP BY 1) r ON r.package = c.c_custkey")
def one_release(f: Facts) -> DataFrame:
    n = f.releases.groupBy("package").agg(F.count("*").alias("n"))
    return f.table("customer").select(F.col("c_custkey").alias("package")).join(n, "package", "left").select("package", heuristics.one_release(F.col("n")).alias("result"))


@query("closer_join_date", """+ j AS (SELECT user_id AS package, ts AS joined FROM events WHERE event_type = 'signup'), l AS (SELECT package, max(upload_time) AS released FROM releases GROUP BY 1)
SELECT j.package, CASE WHEN count(released) = 0 THEN 'SKIP' WHEN bool_or(abs(date_diff('second', joined, released)) >= 432000) THEN 'PASS' ELSE 'FAIL' END AS result FROM j LEFT JOIN l ON l.package = j.package GROUP BY 1""")
def closer_join_date(f: Facts) -> DataFrame:
    j = f.table("events").where("event_type = 'signup'").select(F.col("user_id").alias("package"), F.col("ts").alias("joined"))
    last = f.releases.groupBy("package").agg(F.max("upload_time").alias("released"))
    return heuristics.closer_release_join_date(j.join(last, "package", "left"), "package", "joined", "released")


@query("anomalous_version", """+ x AS (SELECT o_orderkey AS id, 0 AS epoch, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN o_orderkey % 40 WHEN 2 THEN CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) ELSE month(o_orderdate) END AS major,
month(o_orderdate) AS minor, day(o_orderdate) AS micro, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 4 AS form FROM orders),
k AS (SELECT id, major, minor, CASE WHEN major IN (y, y % 100) THEN 'calendar' WHEN form = 2 THEN 'calendar'
WHEN ((major = m AND minor BETWEEN d - 4 AND d + 4) OR (major BETWEEN d - 4 AND d + 4 AND minor = m)) AND micro IN (y, y % 100) THEN 'calendar' ELSE 'semantic' END AS kind FROM x)
SELECT id, kind, CASE WHEN kind = 'semantic' AND major > 20 THEN 'FAIL' ELSE 'PASS' END AS result FROM k""")
def anomalous_version(f: Facts) -> DataFrame:
    o, at = f.table("orders"), F.col("o_orderdate")
    m4 = F.col("o_orderkey") % 4
    major = F.when(m4 == 0, F.year(at).cast("bigint")).when(m4 == 1, F.col("o_orderkey") % 40).when(m4 == 2, F.date_format(at, "yyyyMMdd").cast("bigint")).otherwise(F.month(at).cast("bigint"))
    x = o.select(F.col("o_orderkey").alias("id"), major.alias("major"), at.alias("at"))
    a = heuristics.anomalous_version(F.lit(0), F.col("major"), F.month("at"), F.day("at"), F.col("at"), F.lit(True))
    return x.select("id", a.alias("a")).select("id", "a.kind", "a.result")


#: A component name recorded this often, in whatever letter case, is popular.
POPULAR_FROM = 10


@query("typosquat_candidates")
def typosquat_candidates(f: Facts) -> DataFrame:
    name = F.lower(F.regexp_replace("comp_name", r"(?U)^\s+|\s+$", ""))
    names = cut(f.table("bom_components").select(name.alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")))
    # One more than the operator takes: a longer list is refused there, not shortened here.
    popular = [r.name for r in names.where(F.col("n") >= POPULAR_FROM).orderBy(F.col("n").desc(), "name").limit(100_001).collect()]
    return heuristics.typosquatting(names.select("name"), "name", popular)


@query("fake_email", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'SKIP' WHEN regexp_matches(text, '" + heuristics.EMAIL.replace("'", "''") + "') THEN 'PASS' ELSE 'FAIL' END AS result FROM documents", facts=False)
def fake_email(f: Facts) -> DataFrame:
    return f.table("documents").select("doc_id", heuristics.fake_email(F.col("text")).alias("result"))


@query("description_intent", r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\b(?:stub|placeholder|dependency confusion|security|namespace protection|reserved|prevent)\b') THEN 'PASS' ELSE 'FAIL' END AS result FROM documents", facts=False)
def description_intent(f: Facts) -> DataFrame:
    return f.table("documents").select("doc_id", heuristics.description_intent(F.col("text")).alias("result"))


@query("stub_name", "SELECT row_id, CASE WHEN contains(lower(comp_name), 'stub') THEN 'PASS' ELSE 'FAIL' END AS result FROM bom_components", facts=False)
def stub_name(f: Facts) -> DataFrame:
    return f.table("bom_components").select("row_id", heuristics.stub_name(F.col("comp_name")).alias("result"))


@query("suspicious_imports", r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'SKIP' WHEN len(list_filter(regexp_extract_all(text, '(?m)^[ \t]*(?:import|from)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda x: contains(x, 'base64') OR contains(x, 'request'))) > 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM documents""", facts=False)
def suspicious_imports(f: Facts) -> DataFrame:
    return f.table("documents").select("doc_id", heuristics.suspicious_setup(heuristics.python_imports(F.col("text"))).alias("result"))


@query("similar_structure", """+ h AS (SELECT l_orderkey AS package, o_custkey AS maintainer, sha256(array_to_string(list_sort(list(DISTINCT l_linestatus || l_returnflag)), chr(10))) AS hash FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
t AS (SELECT maintainer, hash, count(*) AS n FROM h GROUP BY 1, 2)
SELECT h.package, CASE WHEN n > 1 THEN 'FAIL' ELSE 'PASS' END AS result FROM h JOIN t USING (maintainer, hash)""")
def similar_structure(f: Facts) -> DataFrame:
    files = f.table("lineitem").select(F.col("l_orderkey").alias("package"), F.concat("l_linestatus", "l_returnflag").alias("name"))
    h = heuristics.structure_hash(files, "package", "name").join(f.table("orders").select(F.col("o_orderkey").alias("package"), F.col("o_custkey").alias("maintainer")), "package")
    return heuristics.similar_projects(h, "package", "maintainer")


@query("type_stub_file", "SELECT package_name, CASE WHEN sum(CASE WHEN ends_with(filename, '.pyi') THEN 1 ELSE 0 END) >= 10 THEN 'PASS' ELSE 'FAIL' END AS result FROM release_files GROUP BY 1", facts=False)
def type_stub_file(f: Facts) -> DataFrame:
    return heuristics.type_stub_files(f.table("release_files"), "package_name", "filename")


@query("wheel_absence", "SELECT package_name, CASE WHEN count(*) FILTER (packagetype = 'bdist_wheel') = 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM release_files GROUP BY 1", facts=False)
def wheel_absence(f: Facts) -> DataFrame:
    n = f.table("release_files").groupBy("package_name").agg(F.sum((F.col("packagetype") == "bdist_wheel").cast("int")).alias("n"))
    return n.select("package_name", heuristics.wheel_absence(F.col("n")).alias("result"))


# ---------------------------------------------------------------------------------------------------------------------
# Checks


@query("check_status_summary", "SELECT component_id, count(*) FILTER (passed = 1) AS passed, count(*) FILTER (passed = 0) AS failed, 0 AS unknown, 0 AS skipped, 0 AS disabled FROM check_result GROUP BY 1")
def check_status_summary(f: Facts) -> DataFrame:
    r = f.check_result.select("component_id", F.when(F.col("passed") == 1, "PASSED").otherwise("FAILED").alias("result_type"))
    return checks.status_summary(r, "component_id")


@query("check_gate_eval", "+ w AS (SELECT component_id, " + ", ".join(f"coalesce(max(CASE WHEN check_id = '{c}' THEN CASE passed WHEN 1 THEN 'PASSED' ELSE 'FAILED' END END), 'UNKNOWN') AS {a}" for a, c in (("vcs", "mcn_version_control_system_1"), ("trusted", "mcn_trusted_builder_level_three_1"), ("code", "mcn_build_as_code_1"), ("svc", "mcn_build_service_1"), ("script", "mcn_build_script_1"))) + """ FROM check_result GROUP BY 1),
a AS (SELECT component_id, vcs, CASE WHEN vcs = 'PASSED' THEN trusted ELSE 'FAILED' END AS trusted, CASE WHEN vcs = 'PASSED' THEN script ELSE 'FAILED' END AS script, code, svc FROM w),
b AS (SELECT component_id, vcs, trusted, script, CASE WHEN trusted = 'FAILED' THEN code ELSE 'PASSED' END AS code, svc FROM a)
SELECT component_id, vcs, trusted, script, code, CASE WHEN code = 'FAILED' THEN svc ELSE 'PASSED' END AS svc FROM b""")
def check_gate_eval(f: Facts) -> DataFrame:
    names = ["mcn_version_control_system_1", "mcn_trusted_builder_level_three_1", "mcn_build_as_code_1", "mcn_build_service_1", "mcn_build_script_1"]
    r = f.check_result.select("component_id", "check_id", F.when(F.col("passed") == 1, "PASSED").otherwise("FAILED").alias("r"))
    wide = r.groupBy("component_id").pivot("check_id", names).agg(F.max("r")).na.fill("UNKNOWN", names)
    gates = {c: checks.BUILT_IN_GATES[c] for c in names if c in checks.BUILT_IN_GATES}
    out = checks.apply_gates(wide, {c: g[0] for c, g in gates.items()}, {c: g[1] for c, g in gates.items()})
    return out.toDF("component_id", "vcs", "trusted", "code", "svc", "script")


@query("maintainability_ladder", f"""+ x AS (SELECT s_suppkey AS id, s_suppkey % 11 = 0 AS archived, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 10 = 0 END AS deprecated, (s_suppkey * 31) % 800 AS release_days, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey * 17) % 700 END AS commit_days FROM supplier)
SELECT id, CASE WHEN archived OR coalesce(deprecated, false) THEN 'FAILED' WHEN release_days > 365 THEN CASE WHEN commit_days <= 365 THEN 'PASSED' ELSE 'FAILED' END WHEN commit_days > 365 THEN 'FAILED' ELSE 'PASSED' END AS result_type,
CASE WHEN commit_days IS NOT NULL OR deprecated IS NOT NULL THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM x""")
def maintainability_ladder(f: Facts) -> DataFrame:
    k = F.col("s_suppkey")
    r = checks.maintainability(k % 11 == 0, F.when(k % 5 == 0, k % 10 == 0), (k * 31) % 800, F.when(k % 3 != 0, (k * 17) % 700))
    return f.table("supplier").select(k.alias("id"), r.alias("r")).select("id", "r.result_type", "r.confidence")


@query("license_decision", """SELECT lic_row_id, CASE WHEN license_id IN ('Oxbridge-NC', 'Thornbury-NC-1.0') THEN 'FAILED' ELSE 'PASSED' END AS result_type, CASE WHEN license_id IS NULL OR license_id = 'NOASSERTION' THEN 0.4 ELSE 1.0 END::DOUBLE AS confidence FROM bom_licenses""", facts=False)
def license_decision(f: Facts) -> DataFrame:
    r = checks.license_decision(F.col("license_id"), ("Oxbridge-NC", "Thornbury-NC-1.0"))
    return f.table("bom_licenses").select("lic_row_id", r.alias("r")).select("lic_row_id", "r.result_type", "r.confidence")


@query("scm_fold", """SELECT o_custkey AS component_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'PASSED' WHEN bool_or(o_orderstatus = 'O') THEN 'FAILED' ELSE 'UNKNOWN' END AS result_type FROM orders GROUP BY 1""", facts=False)
def scm_fold(f: Facts) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("UNKNOWN")
    return checks.fold_status(f.table("orders").select(F.col("o_custkey").alias("component_id"), s.alias("s")), "component_id", "s")


@query("provenance_level", """SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 AND id % 5 = 0 THEN 3 WHEN id % 2 = 0 AND id % 7 = 0 THEN 2 WHEN id % 2 = 0 THEN 1 ELSE 0 END AS level FROM component""")
def provenance_level(f: Facts) -> DataFrame:
    i = F.col("id")
    return f.component.select("id", checks.provenance_level(i % 2 == 0, i % 7 == 0, i % 5 == 0, i % 3 == 0).alias("level"))
