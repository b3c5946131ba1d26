"""Queries of readers, writers and single operators, each with its SQL.  Their inputs are texts and rows built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks import sinks
from lodeworks.fact_queries import CLOSURE, query
from lodeworks.functions import text as tx
from lodeworks.functions import urls
from lodeworks.operators import build_spec, checks, dataflow, graph, heuristics, policy, provenance, relational, resolution, sbom, tags
from lodeworks.session import checkpoint_dir
from lodeworks.sources import readers, registries
from lodeworks.sources.facts import Facts

# ---------------------------------------------------------------------------------------------------------------------
# Stores and readers


@query("relation_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation", facts=False)
def relation_roundtrip(f: Facts) -> DataFrame:
    where = f"{checkpoint_dir(f.spark)}/relations-{uuid.uuid4().hex}"
    sinks.write_relations({"nation": f.table("nation").select("n_nationkey", "n_name", "n_regionkey")}, where)
    return readers.read_relation(f.spark, f"{where}/nation", "n_nationkey bigint, n_name string, n_regionkey bigint")


@query("fact_store_views", "SELECT check_id, count(*) AS n FROM check_result GROUP BY 1")
def fact_store_views(f: Facts) -> DataFrame:
    where = f"{checkpoint_dir(f.spark)}/store-{uuid.uuid4().hex}"
    f.check_result.select("id", "check_id").write.parquet(f"{where}/_check_result_{uuid.uuid4().hex[:8]}.parquet")
    view = next(iter(readers.read_fact_store(f.spark, where)))
    return f.spark.sql(f"SELECT check_id, count(*) AS n FROM {view} GROUP BY 1")


@query("relation_declarations", "SELECT unnest(['.decl nation(n_nationkey: symbol, n_name: symbol)', '.decl region(r_regionkey: symbol)']) AS line", facts=False)
def relation_declarations(f: Facts) -> DataFrame:
    text = readers.declarations({"nation": f.table("nation").select("n_nationkey", "n_name"), "region": f.table("region").select("r_regionkey")})
    return f.spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("existing_columns", "SELECT p_partkey, p_size FROM part", facts=False)
def existing_columns(f: Facts) -> DataFrame:
    return relational.existing_columns(f.table("part"), ["p_partkey", "absent", "p_size"])


@query("table_or_underscored", "SELECT count(*) AS n FROM region", facts=False)
def table_or_underscored(f: Facts) -> DataFrame:
    name = f"r{uuid.uuid4().hex}"
    f.table("region").createOrReplaceTempView(f"_{name}")
    return f.spark.sql(f"SELECT count(*) AS n FROM {relational.resolve_table(f.spark, name)}")


@query("pypi_releases", "SELECT o_custkey AS k, 'v' || o_orderkey AS version, 'f' || o_orderkey || '.whl' AS filename, 'bdist_wheel' AS packagetype, md5(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders", facts=False)
def pypi_releases(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    files = F.array(F.struct(F.concat(F.lit("f"), o, F.lit(".whl")).alias("filename"), F.lit("bdist_wheel").alias("packagetype"), F.struct(F.md5(o.cast("string")).alias("sha256")).alias("digests")))
    one = f.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("v"), o), files))).alias("m"))
    return registries.pypi_releases(one.select("k", F.to_json(F.struct(F.col("m").alias("releases"))).alias("t")), "k", "t").drop("upload_time")


@query("npm_latest", "SELECT p_partkey AS k, p_size || '.0.0' AS latest, 'https://x.example/' || p_size AS tarball FROM part WHERE p_partkey % 5 <> 0", facts=False)
def npm_latest(f: Facts) -> DataFrame:
    v = F.concat(F.col("p_size"), F.lit(".0.0"))
    body = F.struct(F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("latest"), v)).alias("dist-tags"), F.create_map(v, F.struct(F.struct(F.concat(F.lit("https://x.example/"), "p_size").alias("tarball")).alias("dist")), F.lit("0"), F.lit(None)).alias("versions"))
    return registries.npm_latest(f.table("part").select(F.col("p_partkey").alias("k"), F.to_json(body).alias("t")), "k", "t")


@query("maven_latest_release", "SELECT o_custkey AS k, 'v' || arg_max(o_orderkey, o_orderdate::DATE::VARCHAR || lpad(CAST('v' || o_orderkey AS VARCHAR), 20, ' ')) IS NOT NULL AS found, max(o_orderdate)::TIMESTAMP AS published FROM orders GROUP BY 1", facts=False)
def maven_latest_release(f: Facts) -> DataFrame:
    docs = F.collect_list(F.struct(F.concat(F.lit("v"), "o_orderkey").alias("v"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).alias("timestamp")))
    d = f.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_json(F.struct(F.struct(docs.alias("docs")).alias("response"))).alias("t"))
    return registries.latest_release(registries.maven_timestamps(d, "k", "t"), "k").select("k", F.col("version").isNotNull().alias("found"), "published")


@query("folder_assets", "SELECT s_suppkey AS k, '/1.' || s_nationkey AS path, true AS is_folder, '1.' || s_nationkey AS version, CAST(NULL AS VARCHAR) AS sha256 FROM supplier UNION ALL SELECT s_suppkey, '/a.jar', false, NULL, md5(s_name) FROM supplier", facts=False)
def folder_assets(f: Facts) -> DataFrame:
    kids = F.array(F.struct(F.concat(F.lit("/1."), "s_nationkey").alias("uri"), F.lit(True).alias("folder"), F.lit(None).cast("struct<sha256:string>").alias("checksums")), F.struct(F.lit("/a.jar").alias("uri"), F.lit(False).alias("folder"), F.struct(F.md5("s_name").alias("sha256")).alias("checksums")))
    return registries.folder_assets(f.table("supplier").select(F.col("s_suppkey").alias("k"), F.to_json(F.struct(kids.alias("children"))).alias("t")), "k", "t")


@query("package_links", "SELECT s_suppkey AS k, 'SOURCE_REPO' AS label, 'https://github.com/o/' || s_suppkey AS url FROM supplier", facts=False)
def package_links(f: Facts) -> DataFrame:
    body = F.struct(F.struct(F.array(F.struct(F.lit("SOURCE_REPO").alias("label"), F.concat(F.lit("https://github.com/o/"), "s_suppkey").alias("url"))).alias("links")).alias("version"))
    return registries.package_links(f.table("supplier").select(F.col("s_suppkey").alias("k"), F.to_json(body).alias("t")), "k", "t")


@query("vulnerability_batch", "SELECT s_suppkey AS k, 1 AS n, 'V-' || s_nationkey AS id FROM supplier", facts=False)
def vulnerability_batch(f: Facts) -> DataFrame:
    text = F.concat(F.lit('{"results": [{}, {"vulns": [{"id": "V-'), "s_nationkey", F.lit('"}]}]}'))
    return registries.vulnerability_batch(f.table("supplier").select(F.col("s_suppkey").alias("k"), text.alias("t")), "k", "t")


@query("matching_run", "WITH r AS (SELECT o_custkey AS k, o_orderkey AS run_id, o_orderkey % 3 AS w, md5(CAST(o_orderkey % 5 AS VARCHAR)) AS h FROM orders) SELECT k, min(run_id) AS run_id FROM r WHERE w = 1 AND h = md5('2') GROUP BY 1", facts=False)
def matching_run(f: Facts) -> DataFrame:
    o = F.col("o_orderkey")
    runs = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(o.alias("id"), (o % 3 + F.col("o_custkey") * 10).alias("workflow_id"), F.md5((o % 5).cast("string")).alias("head_sha")))).alias("workflow_runs")))
    pages = f.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(runs.alias("t"))
    r = registries.workflow_runs(pages, "k", "t").select("run_id", "workflow_id", "head_sha", F.col("run_id").alias("n"))
    wanted = pages.select("k", (F.col("k") * 10 + 1).alias("workflow_id"), F.md5(F.lit("2")).alias("head_sha"))
    return resolution.matching_run(wanted, r, "k")


@query("ini_lists", "SELECT n_nationkey AS k, 'net' AS section, 'hosts' AS key, [n_name, 'b' || n_regionkey] AS items FROM nation", facts=False)
def ini_lists(f: Facts) -> DataFrame:
    text = F.concat(F.lit("# c\n[net]\nHosts =\n  "), "n_name", F.lit("\n\n  b"), "n_regionkey", F.lit("\n  "), "n_name", F.lit("\n"))
    e = f.table("nation").select(F.col("n_nationkey").alias("k"), F.explode(tx.ini_entries(F.regexp_replace(text, "\n\n", "\n"))).alias("e"))
    return e.select("k", "e.section", "e.key", tx.ini_list(F.col("e.value")).alias("items"))


# ---------------------------------------------------------------------------------------------------------------------
# Writers


@query("html_rows", "SELECT '<tr><td>' || n_nationkey || '</td><td>&lt;' || n_name || '&gt;</td></tr>' AS html FROM nation", facts=False)
def html_rows(f: Facts) -> DataFrame:
    return sinks.html_rows(f.table("nation").select("n_nationkey", F.concat(F.lit("<"), "n_name", F.lit(">")).alias("name")), ["n_nationkey", "name"]).select("html")


@query("dot_edges", "SELECT '  \"' || parent || '\" -> \"' || child || '\";' AS line FROM dependency")
def dot_edges(f: Facts) -> DataFrame:
    return sinks.dot_edges(f.dependency)


@query("flat_cells", "SELECT event_id, 'props.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 'type', event_type FROM events", facts=False)
def flat_cells(f: Facts) -> DataFrame:
    body = F.struct(F.col("event_type").alias("type"), F.from_json("props", "k string").alias("props"))
    return sinks.flat_cells(f.table("events").select("event_id", F.to_json(body).alias("t")), "event_id", "t").where("path in ('props.k', 'type')")


@query("json_cells", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ['a', CAST(o_custkey AS VARCHAR)] ELSE [] END AS cells FROM orders", facts=False)
def json_cells(f: Facts) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('["a", "'), "o_custkey", F.lit('"]'))).when(F.col("o_orderkey") % 3 == 1, "not a list")
    return f.table("orders").select(F.col("o_orderkey").alias("k"), tx.json_cells(t).alias("cells"))


@query("source_report", """SELECT id, '{"repository":"https://' || complete_name || '","commit":"' || md5(complete_name) || '"}' AS report FROM repository""")
def source_report(f: Facts) -> DataFrame:
    r = f.repository.select("id", F.concat(F.lit("https://"), "complete_name").alias("repository"), F.md5("complete_name").alias("commit"))
    return resolution.source_report(r, "id").select("id", "report")


_SPEC = "'groupId=org.g\nartifactId=' || p_name || '\nversion=' || p_size || '\ngitRepo=https://x\ngitTag=v' || p_size || '\ntool=mvn\njdk=17\nnewline=lf\ncommand=\"mvn package\"\n'"


@query("rebuild_files", f"SELECT p_partkey AS k, {_SPEC} AS rebuild FROM part", facts=False)
def rebuild_files(f: Facts) -> DataFrame:
    s = f.table("part").select(F.col("p_partkey").alias("k"), F.lit("org.g").alias("group"), F.col("p_name").alias("artifact"), F.col("p_size").alias("version"), F.lit("https://x").alias("repository"), F.concat(F.lit("v"), "p_size").alias("tag"), F.lit("mvn").alias("tool"), F.lit("17").alias("jdk"), F.lit("mvn package").alias("command"))
    return build_spec.rebuild_file(s).select("k", "rebuild")


@query("spec_documents", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS spec FROM nation""", facts=False)
def spec_documents(f: Facts) -> DataFrame:
    return build_spec.spec_json(f.table("nation").select("n_nationkey", "n_name")).select("n_nationkey", "spec")


@query("dockerfiles", "SELECT n_nationkey AS k, 'FROM python:3.' || n_regionkey || '-slim\nRUN git clone https://x /src && git -C /src checkout --force ' || n_name || '\nWORKDIR /src\nRUN make\n' AS dockerfile FROM nation", facts=False)
def dockerfiles(f: Facts) -> DataFrame:
    n = f.table("nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("3."), "n_regionkey").alias("python_version"), F.lit("https://x").alias("repository"), F.col("n_name").alias("commit"), F.lit("make").alias("command"))
    return sinks.dockerfile(n).select("k", "dockerfile")


# ---------------------------------------------------------------------------------------------------------------------
# Policies, checks, graphs


@query("policy_exit_status", "SELECT 'data_error' AS status", facts=False)
def policy_exit_status(f: Facts) -> DataFrame:
    t = f.component.select(F.lit("p").alias("policy"), F.col("id").alias("component_id"))
    v = policy.evaluate(t.where("component_id % 2 = 0"), t, f.analysis.select(F.col("id").alias("analysis_id")), f.component)
    return f.spark.createDataFrame([(policy.exit_status(v),)], "status string")


@query("template_policy", """+ r AS (SELECT id, component_id, CASE check_id WHEN 'mcn_build_script_1' THEN 'mcn_detect_malicious_metadata_1' ELSE check_id END AS check_id, passed FROM check_result)""" + CLOSURE.replace("+ closure", ", closure") + """,
ok AS (SELECT component_id FROM r WHERE check_id = 'mcn_detect_malicious_metadata_1' AND passed = 1),
bad AS (SELECT parent FROM closure WHERE child NOT IN (SELECT component_id FROM ok))
SELECT 'malware-detection-dependencies' AS policy, component_id FROM ok WHERE component_id NOT IN (SELECT parent FROM bad)""")
def template_policy(f: Facts) -> DataFrame:
    cr = f.check_result.withColumn("check_id", F.when(F.col("check_id") == "mcn_build_script_1", "mcn_detect_malicious_metadata_1").otherwise(F.col("check_id")))
    return policy.template_policy("malware-detection-dependencies", f.component, cr, "pkg:.*", graph.transitive_closure(f.dependency))[0].distinct()


@query("passed_as_bool", "SELECT DISTINCT o_orderstatus AS s, o_orderstatus = 'P' AS passed FROM orders", facts=False)
def passed_as_bool(f: Facts) -> DataFrame:
    r = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("SKIPPED")
    return f.table("orders").select(F.col("o_orderstatus").alias("s"), checks.passed_as_bool(r).alias("passed")).distinct()


@query("all_verified", "SELECT o_custkey AS k, bool_and(o_orderstatus = 'F') AS verified FROM orders GROUP BY 1", facts=False)
def all_verified(f: Facts) -> DataFrame:
    return checks.all_verified(f.table("orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("v")), "k", "v")


@query("ordered_results", "SELECT component_id, list(check_id || '=' || passed ORDER BY passed DESC, check_id) AS results FROM check_result GROUP BY 1")
def ordered_results(f: Facts) -> DataFrame:
    one = F.struct((-F.col("passed")).alias("a"), F.col("check_id").alias("b"), F.concat("check_id", F.lit("="), "passed").alias("c"))
    return f.check_result.groupBy("component_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("results"))


_TREE = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "f")]


@query("check_tree", "WITH RECURSIVE e(parent, child) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TREE) + "), t AS (SELECT DISTINCT parent AS node, parent AS path FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, t.path || '/' || e.child FROM t JOIN e ON e.parent = t.node) SELECT node, path FROM t", facts=False)
def check_tree(f: Facts) -> DataFrame:
    return graph.tree_paths(f.spark.createDataFrame(_TREE, "parent string, child string"))


@query("direct_dependencies", """WITH b AS (SELECT bom_num AS id, bom_json AS j FROM bom_documents WHERE json_valid(bom_json)), d AS (SELECT id, json_extract_string(j, '$.metadata.component."bom-ref"') AS root, unnest(CAST(json_extract(j, '$.dependencies') AS JSON[])) AS x FROM b)
SELECT DISTINCT id, json_extract_string(x, '$.ref') AS parent_ref, unnest(CAST(json_extract(x, '$.dependsOn') AS VARCHAR[])) AS child_ref FROM d WHERE json_extract_string(x, '$.ref') = root""", facts=False)
def direct_dependencies(f: Facts) -> DataFrame:
    return sbom.dependencies(sbom.parsed(f.table("bom_documents"), "bom_num", "bom_json"), direct_only=True)


# ---------------------------------------------------------------------------------------------------------------------
# Builds, sources


@query("detected_tools", """WITH x AS (SELECT l_orderkey AS k, ['a/b/', 'a/', ''][l_linenumber % 3 + 1] || ['pom.xml', 'go.mod', 'README', 'setup.py'][l_partkey % 4 + 1] AS path FROM lineitem),
t AS (SELECT k, path, CASE WHEN ends_with(path, 'pom.xml') THEN 'maven' WHEN ends_with(path, 'go.mod') THEN 'go' WHEN ends_with(path, 'setup.py') THEN 'pip' END AS tool FROM x WHERE NOT ends_with(path, 'README'))
SELECT k, tool, arg_min(path, length(path)) AS path FROM t WHERE k % 2 = 1 OR tool = 'maven' GROUP BY 1, 2""", facts=False)
def detected_tools(f: Facts) -> DataFrame:
    path = F.concat(F.get(F.array(F.lit("a/b/"), F.lit("a/"), F.lit("")), (F.col("l_linenumber") % 3).cast("int")), F.get(F.array(*map(F.lit, ("pom.xml", "go.mod", "README", "setup.py"))), (F.col("l_partkey") % 4).cast("int")))
    x = f.table("lineitem").select(F.col("l_orderkey").alias("k"), path.alias("path"), F.when(F.col("l_orderkey") % 2 == 0, "maven").otherwise("other").alias("type"))
    return build_spec.detected_tools(x, "k", "path", "type")


@query("best_tool_by_language", """WITH t AS (SELECT l_orderkey AS k, ['pip', 'poetry', 'maven'][l_linenumber % 3 + 1] AS tool, CASE WHEN l_linenumber % 3 = 2 THEN 'java' ELSE 'python' END AS lang, CAST(l_quantity AS DOUBLE) AS c FROM lineitem)
SELECT k, arg_min(tool, tool) FILTER (c = m) AS tool, m AS confidence FROM (SELECT *, max(c) OVER (PARTITION BY k) AS m FROM t WHERE lang = 'python') GROUP BY k, m""", facts=False)
def best_tool_by_language(f: Facts) -> DataFrame:
    m = (F.col("l_linenumber") % 3).cast("int")
    t = f.table("lineitem").select(F.col("l_orderkey").alias("k"), F.get(F.array(F.lit("pip"), F.lit("poetry"), F.lit("maven")), m).alias("tool"), F.when(m == 2, "java").otherwise("python").alias("tool_language"), F.lit("python").alias("language"), F.col("l_quantity").cast("double").alias("confidence"))
    return build_spec.best_tool_by_language(t, "k")


@query("project_matches", "SELECT p_partkey AS k, p_partkey % 2 = 0 AND p_size % 3 = 0 AS matches FROM part", facts=False)
def project_matches(f: Facts) -> DataFrame:
    pom = F.concat(F.lit("<project><parent><groupId>g"), F.col("p_partkey") % 2, F.lit("</groupId></parent><artifactId>a"), F.col("p_size") % 3, F.lit("</artifactId></project>"))
    c = readers.pom_coordinates(pom)
    return f.table("part").select(F.col("p_partkey").alias("k"), build_spec.project_matches(c["group"], c["artifact"], F.lit("g0"), F.lit("a0")).alias("matches"))


@query("pip_confidence", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 3 = 2 THEN 0.5 ELSE 1.0 END ELSE CASE WHEN p_size > 20 THEN 0.5 ELSE 1.0 END END::DOUBLE AS confidence FROM part", facts=False)
def pip_confidence(f: Facts) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "pyproject.toml").otherwise("setup.py")
    backend = F.when(F.col("p_size") % 3 == 1, "setuptools.build_meta").when(F.col("p_size") % 3 == 2, "flit_core")
    return f.table("part").select(F.col("p_partkey").alias("k"), build_spec.pip_confidence(name, backend, (F.col("p_size") > 20).cast("int")).alias("confidence"))


@query("rust_toolchain", """SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN CASE p_size % 3 WHEN 0 THEN '1.7' || p_size % 10 WHEN 1 THEN '>=1.6' || p_size % 10 ELSE 'stable' END END AS toolchain FROM part""", facts=False)
def rust_toolchain(f: Facts) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    file = F.when(s % 3 == 0, F.concat(F.lit('[toolchain]\nchannel = "1.7'), s % 10, F.lit('"\n')))
    t = build_spec.rust_toolchain(F.when(k == 1, "maturin"), F.when(k == 2, F.array(F.lit("setuptools-rust>=1"))), k == 3, file, F.when(s % 3 == 1, F.concat(F.lit("1.6"), s % 10)))
    return f.table("part").select(F.col("p_partkey").alias("k"), t.alias("toolchain"))


@query("wheel_generators", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'wheel' WHEN 1 THEN 'poetry-core' END AS backend, CASE p_partkey % 3 WHEN 0 THEN '0.' || p_size WHEN 1 THEN '1.' || p_size END AS version FROM part", facts=False)
def wheel_generators(f: Facts) -> DataFrame:
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("Generator: bdist_wheel (0."), "p_size", F.lit(")"))).when(k == 1, F.concat(F.lit("Generator: poetry-core 1."), "p_size")).otherwise("Root-Is-Purelib: true")
    g = build_spec.wheel_generator(line)
    return f.table("part").select(F.col("p_partkey").alias("k"), g["backend"].alias("backend"), g["version"].alias("version"))


@query("first_config", """WITH x AS (SELECT l_orderkey AS k, ['z/', 'a/', 'a/b/'][l_linenumber % 3 + 1] || CASE WHEN l_partkey % 2 = 0 THEN 'pom.xml' ELSE 'x.txt' END AS path FROM lineitem)
SELECT k, min(struct_pack(d := length(path) - length(replace(path, '/', '')), p := path)).p AS path FROM x WHERE ends_with(path, 'pom.xml') GROUP BY 1""", facts=False)
def first_config(f: Facts) -> DataFrame:
    path = F.concat(F.get(F.array(F.lit("z/"), F.lit("a/"), F.lit("a/b/")), (F.col("l_linenumber") % 3).cast("int")), F.when(F.col("l_partkey") % 2 == 0, "pom.xml").otherwise("x.txt"))
    return build_spec.first_config(f.table("lineitem").select(F.col("l_orderkey").alias("k"), path.alias("path")), "k", "path", ("pom.xml",))


@query("tool_accepts", "SELECT p_partkey AS k, p_partkey % 3 <> 1 AS accepted FROM part", facts=False)
def tool_accepts(f: Facts) -> DataFrame:
    t = F.get(F.array(F.lit("maven"), F.lit("pypi"), F.lit("github")), (F.col("p_partkey") % 3).cast("int"))
    return f.table("part").select(F.col("p_partkey").alias("k"), build_spec.tool_accepts(t, "maven", ("maven", "pypi", "npm")).alias("accepted"))


@query("command_uses", "SELECT p_partkey AS k, p_partkey % 2 = 0 AND p_size % 2 = 0 AS deploys FROM part", facts=False)
def command_uses(f: Facts) -> DataFrame:
    c = F.array(F.when(F.col("p_partkey") % 2 == 0, "/usr/bin/mvn").otherwise("make"), F.lit("-q"), F.when(F.col("p_size") % 2 == 0, "deploy").otherwise("test"))
    return f.table("part").select(F.col("p_partkey").alias("k"), build_spec.command_uses(c, ("mvn", "gradle"), ("deploy",)).alias("deploys"))


@query("latest_version_fallback", """WITH w AS (SELECT o_orderkey AS version, o_custkey AS k FROM orders), l AS (SELECT k, max(version) AS v FROM w GROUP BY 1)
SELECT w.k, CAST(w.version AS VARCHAR) AS version, CASE WHEN w.version % 2 = 0 THEN 'r' || w.version WHEN l.v % 3 <> 0 THEN 'latest' || l.v END AS repository, w.version % 2 = 1 AND l.v % 3 <> 0 AS fallback FROM w JOIN l USING (k)""", facts=False)
def latest_version_fallback(f: Facts) -> DataFrame:
    o = f.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("version"))
    found = o.where("n % 2 = 0").select("k", "version", F.concat(F.lit("r"), "n").alias("repository"))
    latest = o.groupBy("k").agg(F.max("n").alias("n")).where("n % 3 <> 0").select("k", F.concat(F.lit("latest"), "n").alias("repository"))
    return resolution.latest_version_fallback(o, found, latest, "k")


@query("find_commit", """SELECT s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN substr(md5(s_name), 1, 12) WHEN 1 THEN 'v1.' || s_suppkey WHEN 2 THEN 'v1.0.0-20240102030405-' || substr(md5(s_name), 1, 12) ELSE '2.' || s_suppkey END AS version,
CASE s_suppkey % 4 WHEN 0 THEN substr(md5(s_name), 1, 12) WHEN 1 THEN 'c1' WHEN 2 THEN substr(md5(s_name), 1, 12) ELSE 'c2' END AS commit, CASE s_suppkey % 4 WHEN 0 THEN 'hash' WHEN 1 THEN 'tag' WHEN 2 THEN 'pseudo_version' ELSE 'matched' END AS outcome FROM supplier""", facts=False)
def find_commit(f: Facts) -> DataFrame:
    k, h = F.col("s_suppkey"), F.substring(F.md5("s_name"), 1, 12)
    v = F.when(k % 4 == 0, h).when(k % 4 == 1, F.concat(F.lit("v1."), k)).when(k % 4 == 2, F.concat(F.lit("v1.0.0-20240102030405-"), h)).otherwise(F.concat(F.lit("2."), k))
    s = f.table("supplier")
    listed = s.select(k.alias("repo"), F.explode(F.array(F.struct(F.concat(F.lit("v1."), k).alias("tag"), F.lit("c1").alias("commit")), F.struct(F.concat(F.lit("release-2."), k).alias("tag"), F.lit("c2").alias("commit")))).alias("t")).select("repo", "t.*")
    return tags.find_commit(s.select(k.alias("repo"), F.lit("n").alias("name"), v.alias("version")), listed).select("repo", "version", "commit", "outcome")


@query("subject_matches", "SELECT p_partkey AS k, p_partkey % 2 = 0 AS matches FROM part", facts=False)
def subject_matches(f: Facts) -> DataFrame:
    name = F.concat(F.lit("dist/n-"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(-1), F.lit(".jar"))
    return f.table("part").select(F.col("p_partkey").alias("k"), provenance.subject_matches(name, F.concat(F.lit("pkg:maven/g/n@"), "p_size")).alias("matches"))


@query("provenance_conflicts", "SELECT p_partkey AS k, p_partkey % 3 = 1 AS conflict FROM part", facts=False)
def provenance_conflicts(f: Facts) -> DataFrame:
    other = F.when(F.col("p_partkey") % 3 == 0, F.lit("a")).when(F.col("p_partkey") % 3 == 1, "b")
    return f.table("part").select(F.col("p_partkey").alias("k"), provenance.conflicts(F.lit("a"), other).alias("conflict"))


@query("scm_verdicts", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'PASSED' WHEN 3 THEN 'FAILED' ELSE 'UNKNOWN' END AS verdict FROM part", facts=False)
def scm_verdicts(f: Facts) -> DataFrame:
    k = F.col("p_partkey") % 5
    group = F.when(k == 1, F.lit(None)).when(k == 2, "io.github.owner").otherwise("org.acme.tool")
    v = checks.scm_verdict(group, F.lit("Owner"), F.when(k == 3, "org.other"), k == 0)
    return f.table("part").select(F.col("p_partkey").alias("k"), v.alias("verdict"))


# ---------------------------------------------------------------------------------------------------------------------
# Dataflow, texts


@query("sequence_edges", "SELECT src, dst FROM (SELECT l_orderkey * 10 + l_linenumber AS src, lead(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS dst FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE dst IS NOT NULL", facts=False)
def sequence_edges(f: Facts) -> DataFrame:
    s = f.table("lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node")).distinct()
    return dataflow.sequence_edges(s, "job", "n")


@query("branch_edges", """WITH i AS (SELECT o_orderkey * 10 AS c, o_orderkey * 10 + 1 AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 + 2 END AS e, o_orderkey * 10 + 3 AS x FROM orders)
SELECT c AS src, t AS dst FROM i UNION SELECT c, coalesce(e, x) FROM i UNION SELECT t, x FROM i UNION SELECT e, x FROM i WHERE e IS NOT NULL""", facts=False)
def branch_edges(f: Facts) -> DataFrame:
    k = F.col("o_orderkey") * 10
    return dataflow.branch_edges(f.table("orders").select(k.alias("cond"), (k + 1).alias("then_node"), F.when(F.col("o_orderkey") % 2 == 0, k + 2).alias("else_node"), (k + 3).alias("exit_node")))


@query("files_under", "SELECT p_partkey AS read, p_partkey AS node, 'dist/' || p_size % 3 || '/x' AS location, p_name AS value FROM part WHERE p_size % 3 = 1", facts=False)
def files_under(f: Facts) -> DataFrame:
    p = f.table("part")
    state = p.select(F.col("p_partkey").alias("node"), F.concat(F.lit("dist/"), F.col("p_size") % 3, F.lit("/x")).alias("location"), F.col("p_name").alias("value"))
    reads = p.select(F.col("p_partkey").alias("read"), F.col("p_partkey").alias("node"), F.lit("dist/1").alias("directory"))
    return dataflow.files_under(state, reads)


@query("consistent_choices", "SELECT l_orderkey AS k, max(l_linestatus) AS status FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1", facts=False)
def consistent_choices(f: Facts) -> DataFrame:
    b = f.table("lineitem").select(F.col("l_orderkey").alias("k"), F.lit("status").alias("name"), F.col("l_linestatus").alias("value"))
    return dataflow.consistent_choices(b, "k", "name", "value").select("k", F.col("bindings")["status"].alias("status"))


@query("secrets_reached", "SELECT DISTINCT p_partkey AS node, 'T' || p_size AS secret FROM part WHERE p_size % 2 = 0", facts=False)
def secrets_reached(f: Facts) -> DataFrame:
    v = F.concat(F.when(F.col("p_size") % 2 == 0, "secrets.T").otherwise("env.T"), "p_size")
    return dataflow.secrets_reached(f.table("part").select(F.col("p_partkey").alias("node"), v.alias("value")))


@query("text_values", """SELECT n_nationkey AS k, n_name || '-' || n_regionkey AS joined, n_name AS base, n_name AS decoded, [n_name, CAST(n_regionkey AS VARCHAR)] AS parts, ['run', n_name || ' x'] AS words FROM nation""", facts=False)
def text_values(f: Facts) -> DataFrame:
    n = F.col("n_name")
    return f.table("nation").select(
        F.col("n_nationkey").alias("k"), tx.concat_capped(n, F.lit("-"), F.col("n_regionkey").cast("string")).alias("joined"), tx.basename(F.concat(F.lit("a/"), n, F.lit("/"))).alias("base"),
        tx.decode_base64(F.base64(F.encode(n, "utf-8"))).alias("decoded"), tx.split_literal(F.concat(n, F.lit("."), "n_regionkey"), ".").alias("parts"), tx.quoted_words(F.concat(F.lit("run '"), n, F.lit(" x'"))).alias("words"),
    )


@query("deploy_evidence", "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 1.0 WHEN p_size % 2 = 0 OR p_partkey % 2 = 0 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM part", facts=False)
def deploy_evidence(f: Facts) -> DataFrame:
    path = F.concat(F.lit(".github/"), F.when(F.col("p_size") % 2 == 0, "deploy-").otherwise("build-"), "p_size", F.lit(".yml"))
    return f.table("part").select(F.col("p_partkey").alias("k"), tx.deploy_evidence(path, F.col("p_partkey") % 2 == 0).alias("confidence"))


@query("best_effort_text", "SELECT n_nationkey AS k, n_name || 'é' AS text FROM nation", facts=False)
def best_effort_text(f: Facts) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit("é")), "utf-8")).otherwise(F.encode(F.concat("n_name", F.lit("é")), "iso-8859-1"))
    return f.table("nation").select(F.col("n_nationkey").alias("k"), tx.best_effort(raw).alias("text"))


@query("shell_words", "SELECT p_partkey AS k, p_partkey % 4 IN (0, 1) AS single FROM part", facts=False)
def shell_words(f: Facts) -> DataFrame:
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("a-$X"), "p_size")).when(k == 1, F.concat(F.lit("'two words'"), "p_size")).when(k == 2, "two words").otherwise("a|b")
    return f.table("part").select(F.col("p_partkey").alias("k"), tx.single_word(t).alias("single"))


@query("python_commands", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'build' END AS module, CASE p_partkey % 3 WHEN 1 THEN 'setup.py' END AS script, CASE p_partkey % 3 WHEN 0 THEN ['--wheel'] WHEN 1 THEN ['bdist', 's' || p_size] END AS args FROM part", facts=False)
def python_commands(f: Facts) -> DataFrame:
    k = F.col("p_partkey") % 3
    w = F.when(k == 0, F.array(F.lit("/usr/bin/python3.11"), F.lit("-m"), F.lit("build"), F.lit("--wheel"))).when(k == 1, F.array(F.lit("python"), F.lit("-u"), F.lit("setup.py"), F.lit("bdist"), F.concat(F.lit("s"), "p_size"))).otherwise(F.array(F.lit("make")))
    p = tx.python_command(w)
    return f.table("part").select(F.col("p_partkey").alias("k"), p["module"].alias("module"), p["script"].alias("script"), p["args"].alias("args"))


@query("purl_domains", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'pypi.org' END AS domain, n_nationkey % 2 = 0 AS same FROM nation", facts=False)
def purl_domains(f: Facts) -> DataFrame:
    k = F.col("n_nationkey")
    t = F.when(k % 3 == 0, "github").when(k % 3 == 1, "pypi").otherwise("other")
    a = F.concat(F.lit("pkg:"), t, F.lit("/o/n@1"))
    b = F.concat(F.lit("pkg:"), t, F.when(k % 2 == 0, "/o/n").otherwise("/o/n@2"))
    return f.table("nation").select(k.alias("k"), urls.purl_domain(a).alias("domain"), urls.purl_equivalent(a, b).alias("same"))


@query("commit_hashes", "SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS is_hash FROM nation", facts=False)
def commit_hashes(f: Facts) -> DataFrame:
    h = F.when(F.col("n_nationkey") % 2 == 0, F.substring(F.md5("n_name"), 1, 20)).otherwise(F.concat(F.lit("v"), "n_nationkey"))
    return f.table("nation").select(F.col("n_nationkey").alias("k"), urls.is_commit_hash(h).alias("is_hash"))


@query("script_pages", "SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS asks FROM nation", facts=False)
def script_pages(f: Facts) -> DataFrame:
    page = F.concat(F.lit("<p>"), F.when(F.col("n_nationkey") % 2 == 0, "Please Enable JavaScript").otherwise("hello"), F.lit("</p>"))
    return f.table("nation").select(F.col("n_nationkey").alias("k"), readers.needs_script(page).alias("asks"))


@query("setuptools_inferred", "SELECT p_partkey AS k, p_partkey % 3 <> 2 AS inferred FROM part", facts=False)
def setuptools_inferred(f: Facts) -> DataFrame:
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("Name: "), "p_name", F.lit("\nLicense-File: LICENSE\n"))).when(k == 1, "Generator: setuptools 70").otherwise("Name: x\n")
    return f.table("part").select(F.col("p_partkey").alias("k"), build_spec.setuptools_inferred(t).alias("inferred"))


@query("project_link_heuristics", "SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS link, CASE WHEN p_size % 3 <> 0 THEN 'SKIP' WHEN p_partkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS repo FROM part", facts=False)
def project_link_heuristics(f: Facts) -> DataFrame:
    links = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("https://x.example"))).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>"))
    repo = F.when(F.col("p_partkey") % 2 == 0, "https://github.com/o/n")
    wide = f.table("part").select(F.col("p_partkey").alias("k"), heuristics.empty_project_link(links).alias("empty_project_link"), heuristics.source_code_repo(repo).alias("source_code_repo"))
    return heuristics.gate(wide).select("k", F.col("empty_project_link").alias("link"), F.col("source_code_repo").alias("repo"))
