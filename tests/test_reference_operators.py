"""Operators of the fact store, policies, rules, recursion, versions, heuristics, checks, dataflow and readers."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks import sinks
from lodeworks.functions import text as tx
from lodeworks.functions import urls, versions
from lodeworks.operators import build_spec, checks, dataflow, graph, heuristics, patterns, policy, provenance, relational, resolution, tags, workflow
from lodeworks.plans import datalog
from lodeworks.sources import readers


def val(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def vals(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


# Recursion -----------------------------------------------------------------------------------------------------------


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent long, child long")


def test_closure(spark):
    got = {tuple(r) for r in graph.transitive_closure(edges(spark, [(1, 2), (2, 3)])).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    again = graph.transitive_closure(edges(spark, list(got)))
    assert {tuple(r) for r in again.collect()} == got


def test_closure_of_a_cycle_and_limit(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert graph.transitive_closure(e).count() == 9
    with pytest.raises(graph.NoFixpoint):
        graph.transitive_closure(edges(spark, [(i, i + 1) for i in range(20)]), max_rounds=1)
    assert graph.transitive_closure(e.limit(0)).count() == 0


def test_levels_and_selection(spark):
    e = edges(spark, [(1, 2), (1, 3), (3, 2), (2, 4)])
    assert {r.node: r.level for r in graph.topological_levels(e).collect()} == {1: 0, 3: 1, 2: 2, 4: 3}
    with pytest.raises(graph.NoFixpoint):
        graph.topological_levels(edges(spark, [(1, 2), (2, 1)]))
    s = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert {r.node for r in graph.selection_closure(s, n, ["*"], []).collect()} == {"a", "b", "c", "d"}
    assert {r.node for r in graph.selection_closure(s, n, ["c"], []).collect()} == {"a", "b", "c"}
    assert {r.node for r in graph.selection_closure(s, n, ["*"], ["b"]).collect()} == {"a", "d"}


def test_aggregate_level_follows_the_weakest_dependency(spark):
    comp = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    lv = [c for n in (1, 2, 3, 4) for c in graph.LEVEL_CHECKS[n]]
    rows = [(1, c, 1) for c in lv] + [(2, c, 1) for c in lv[:4]] + [(3, c, 1) for c in lv]
    cr = spark.createDataFrame(rows, "component_id long, check_id string, passed int")
    got = {r.id: (r.own_level, r.level) for r in graph.aggregate_levels(comp, edges(spark, [(1, 2), (3, 1)]), cr).collect()}
    assert got == {1: (4, 3), 2: (2, 2), 3: (4, 3)}


# Policies and rules --------------------------------------------------------------------------------------------------


def test_satisfies_and_violates_partition_what_applies(spark):
    comp = spark.createDataFrame([(i, f"pkg:x/{i}", i % 2) for i in range(10)], "id long, purl string, analysis_id long")
    an = spark.createDataFrame([(0,), (1,)], "id long")
    t = comp.select(F.lit("p").alias("policy"), F.col("id").alias("component_id"))
    v = policy.evaluate(t.where("component_id < 4"), t, policy.applied_analyses(an, spark.createDataFrame([(1,)], "analysis_id long")), comp)
    assert {r.component_id for r in v.satisfies.collect()} == {1, 3} and {r.component_id for r in v.violates.collect()} == {5, 7, 9}
    assert v.failed.count() == 1 and v.passed.count() == 0 and policy.exit_status(v) == "data_error"
    v = policy.evaluate(t, t, policy.applied_analyses(an, an.limit(0).withColumnRenamed("id", "analysis_id")), comp)
    assert policy.exit_status(v) == "ok" and sinks.policy_report(v).count() == 11
    v = policy.evaluate(t, t.limit(0), an.withColumnRenamed("id", "analysis_id"), comp)
    assert policy.exit_status(v) == "data_error"


def test_template_policies(spark):
    comp = spark.createDataFrame([(1, "pkg:a/x@1", 0), (2, "pkg:a/y@1", 0)], "id long, purl string, analysis_id long")
    cr = spark.createDataFrame([(1, "mcn_detect_malicious_metadata_1", 1)], "component_id long, check_id string, passed int")
    closure = edges(spark, [(1, 2)])
    sat, targets = policy.template_policy("malware-detection", comp, cr, "pkg:a/x.*")
    assert sat.count() == 1 and targets.count() == 1
    assert policy.template_policy("malware-detection-dependencies", comp, cr, ".*", closure)[0].count() == 0
    assert policy.template_policy("malware-detection", comp, cr, "a/x")[1].count() == 0


def run(spark, text, **rel):
    return {n: {tuple(r) for r in d.collect()} for n, d in datalog.Engine(spark, rel).run(text).items()}


def test_rules_closure_negation_and_facts(spark):
    out = run(spark, """
    .decl edge(x: number, y: number)
    edge(1, 2). edge(2, 3). edge(3, 1). edge(4, 4). // a comment
    .decl path(x: number, y: number)
    path(x, y) :- edge(x, y).
    path(x, z) :- path(x, y), path(y, z).
    .decl alone(x: number)
    alone(x) :- edge(x, _), !path(x, 1).
    .output path
    .output alone
    """)  # fmt: skip
    assert len(out["path"]) == 10 and out["alone"] == {(4,)}


def test_rules_aggregates_terms_and_heads(spark):
    e = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "n string, v long")
    out = run(spark, """
    .decl v(n: symbol, x: number)
    .decl a(n: symbol, c: number)
    .decl b(n: symbol, c: number)
    .decl s(t: symbol)
    .decl m(x: number)
    .decl none(x: number)
    a(n, c), b(n, c) :- v(n, _), c = count : { v(n, _x) }.
    s(cat(n, cat("-", to_string(x + 1)))) :- v(n, x), x >= 2, n != "c".
    m(x) :- x = max y : { v(_, y) }.
    none(0) :- 0 = count : { v("z", _y) }.
    """, v=e)  # fmt: skip
    assert out["a"] == out["b"] == {("a", 2), ("b", 1)}
    assert out["s"] == {("a-6",), ("b-3",)} and out["m"] == {(5,)} and out["none"] == {(0,)}


def test_rules_match_is_anchored_and_emptiness(spark):
    c = spark.createDataFrame([("pkg:a/x",), ("pkg:a/xy",)], "p string")
    out = run(spark, '.decl c(p: symbol)\n.decl e(p: symbol)\n.decl r(p: symbol)\n.decl q(p: symbol)\nr(p) :- c(p), match("pkg:a/x", p).\nq(p) :- c(p), !e(_), contains("xy", p).', c=c)
    assert out["r"] == {("pkg:a/x",)} and out["q"] == {("pkg:a/xy",)}


def test_rules_with_unrelated_atoms(spark):
    q = spark.createDataFrame([(1,), (2,)], "x long")
    r = spark.createDataFrame([(2, 7), (3, 8)], "l long, m long")
    out = run(spark, """
    .decl q(x: number)
    .decl r(l: number, m: number)
    .decl a(x: number)
    .decl b(x: number)
    .decl c(x: number)
    .decl d(x: number, m: number)
    .decl e(x: number)
    a(x) :- q(x), r(l, _), l = 2.
    b(x) :- q(x), r(l, _), l = 9.
    c(x) :- r(_, _), q(x).
    d(x, m) :- q(x), r(l, m), l < 3.
    e(1) :- r(_, 8).
    .decl f(x: number)
    f(x) :- q(x), r(l, _), l = 3, 1 = count : { r(l, _y) }.
    """, q=q, r=r)  # fmt: skip
    assert out.pop("f") == {(1,), (2,)}
    assert out == {"a": {(1,), (2,)}, "b": set(), "c": {(1,), (2,)}, "d": {(1, 7), (2, 7)}, "e": {(1,)}}


def test_rules_recursive_subsumption(spark):
    out = run(spark, """
    .decl e(a: number, b: number, w: number)
    e(1, 2, 5). e(2, 3, 5). e(1, 3, 20). e(3, 1, 1).
    .decl d(a: number, w: number)
    d(1, 0).
    d(b, w + x) :- d(a, w), e(a, b, x).
    d(a, x) <= d(a, y) :- x >= y.
    """)  # fmt: skip
    assert out["d"] == {(1, 0), (2, 5), (3, 10)}


@pytest.mark.parametrize(
    "text",
    [
        ".decl p(x: number)\n.decl q(x: number)\np(x) :- q(x), !p(x).\nq(x) :- p(x).",
        ".decl p(x: number)\np(x) :- nowhere(x).",
        ".decl p(x: number)\np(1, 2).",
        ".decl p(x: number)\n.decl q(x: number)\nq(1).\np(y) :- q(x).",
        "p(1).",
        ".decl p(x: number)\np(1)",
        ".decl p(x: number)\np(x) :- ?",
        ".decl p(x: number)\n.decl p(x: number)",
    ],
)
def test_rules_errors(spark, text):
    with pytest.raises(datalog.RuleError):
        datalog.Engine(spark, {}).run(text)


def test_prelude_and_introspection(spark):
    rel = {
        "analysis": spark.createDataFrame([(1, "t")], "id long, t string"),
        "component": spark.createDataFrame([(1, "pkg:a/x", 1), (2, "pkg:a/y", 1)], "id long, purl string, a long"),
        "dependency": edges(spark, [(1, 2)]),
        "check_result": spark.createDataFrame([(1, "mcn_a_1", True, 1), (2, "mcn_a_1", False, 2)], "id long, n string, passed boolean, c long"),
    }
    text = 'Policy("p", c, "ok") :- check_passed(c, "mcn_a_1").\napply_policy_to("p", c) :- component(c, _, a), apply_to_analysis(a).'
    out = {n: {tuple(r) for r in d.collect()} for n, d in datalog.run_policies(datalog.Engine(spark, rel), text).items()}
    assert out["failed_policies"] == {("p",)} and out["passed_policies"] == set()
    assert out["component_satisfies_policy"] == {(1, "pkg:a/x", "p")} and out["component_violates_policy"] == {(2, "pkg:a/y", "p")}
    assert datalog.relations_read(text) == ["apply_to_analysis", "check_passed", "component"]
    none = datalog.run_policies(datalog.Engine(spark, rel), 'apply_policy_to("p", c) :- component(c, _, _), check_failed(c, _).\n.decl seen(n: symbol)\nseen(n) :- is_check(n).\n.output seen')
    assert [tuple(r) for r in none["failed_policies"].collect()] == [("p",)] and none["passed_policies"].count() == 0 and none["seen"].first().n == "mcn_a_1"
    with pytest.raises(datalog.RuleError):
        datalog.run_policies(datalog.Engine(spark, rel), '.decl Policy(a: number)\nPolicy(1).')


# Versions and addresses ----------------------------------------------------------------------------------------------


def test_version_order(spark):
    order = ["0.9", "1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.1", "1.10", "2.0", "1!0.1"]
    keys = vals(spark, order, versions.version_key)
    df = spark.createDataFrame(list(zip(range(len(order)), keys)), "i int, k array<bigint>")
    assert [r.i for r in df.orderBy("k").collect()] == list(range(len(order)))
    a, b, bad, none = vals(spark, ["1.0", "v1.0.0", "one", None], versions.version_key)
    assert a == b and bad is None and none is None


@pytest.mark.parametrize(("version", "lo", "hi", "inside"), [("1.0", "1.0", "2.0", True), ("2.0", "1.0", "2.0", False), ("0.9", "1.0", None, False), ("9", None, None, True), ("1.5", "bad", "2", True), ("1.5", "1", "bad", True), ("bad", "0", None, False)])
def test_range(spark, version, lo, hi, inside):
    assert val(spark, versions.in_range(F.lit(version), F.lit(lo).cast("string"), F.lit(hi).cast("string"))) is inside


def test_last_event_of_a_range_counts(spark):
    t = "adv int, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
    adv = spark.createDataFrame([(1, [(("x", "e"), [("S", [("1.0", None), (None, "2.0"), ("3.0", None), (None, "4.0")])])]), (2, None), (3, [(None, None)]), (4, [(("x", "e"), [("S", None)])])], t)
    p = spark.createDataFrame([("x", "e", v) for v in ("1.5", "3.5", "4.0")], "package string, ecosystem string, version string")
    assert [tuple(r) for r in versions.vulnerable(p, adv).collect()] == [("x", "3.5", 1)]


def test_version_helpers(spark):
    assert vals(spark, ["1.8.0_292", "17.0.1", "8", "25", "4", "x"], versions.jdk_version) == ["8", "17", "8", None, None, None]
    assert vals(spark, ["1.2", "1.3.4", "1.4", "2.0", "1.2.5rc1", "bad"], lambda c: patterns.satisfies(c, "~=1.2,!=1.4,<2")) == [True, True, False, False, True, False]
    assert vals(spark, ["1.2.9", "1.3", "1.2"], lambda c: patterns.satisfies(c, "==1.2.*")) == [True, False, True]
    tagged = spark.createDataFrame([("a", "v1.9"), ("a", "v1.10"), ("a", "nightly"), ("b", "0"), ("c", "x")], "k string, tag string")
    assert {r.k: r.tag for r in versions.highest_tag(tagged, "k", "tag").collect()} == {"a": "v1.10"}


def test_remote_urls(spark):
    texts = ["https://github.com/o/n.git", "git@github.com:o/n.git", "ssh://git@github.com:7999/o/n", "git+https://github.com/o/n/tree/x", "scm:git:git@github.com:o/n.git", "ftp://gitlab.com/o/n", "https://evil.example/o/n", "https://github.com/o", "nonsense", None]
    good = "https://github.com/o/n"
    assert vals(spark, texts, urls.remote_url) == [good, good, good, good, good, "https://gitlab.com/o/n", None, None, None, None]


def test_purls_and_organisations(spark):
    p = vals(spark, ["pkg:maven/org.a/b@1?type=jar#s", "pkg:npm/x", "nope"], urls.parse_purl)
    assert tuple(p[0]) == ("maven", "org.a", "b", "1", "type=jar", "s") and tuple(p[1]) == ("npm", None, "x", None, None, None) and p[2] is None
    assert val(spark, urls.purl_equivalent(F.lit("pkg:npm/x@1"), F.lit("pkg:npm/x"))) and not val(spark, urls.purl_equivalent(F.lit("pkg:npm/x@1"), F.lit("pkg:npm/x@2")))
    assert vals(spark, ["com.github.me.lib", "org.apache.x.y", "io"], urls.organisation) == ["com.github.me", "org.apache", "io"]
    assert vals(spark, ["git+https://h/o/n@refs/tags/v1", "https://h/o/n"], urls.clean_spdx_uri) == ["https://h/o/n"] * 2


# Heuristics ----------------------------------------------------------------------------------------------------------


def test_release_gaps(spark):
    r = spark.createDataFrame([("p", 1, "2024-01-01 00:00:00"), ("p", 2, "2024-01-10 00:00:00"), ("p", 3, "2024-01-20 12:00:00"), ("q", 1, "2024-01-01 00:00:00")], "package string, seq int, t string")
    r = r.withColumn("upload_time", F.col("t").cast("timestamp_ntz"))
    g = {x.package: (x.n_releases, x.mean_gap) for x in heuristics.release_gaps(r).collect()}
    assert g == {"p": (3, 9), "q": (1, None)}


@pytest.mark.parametrize(("a", "b", "j"), [("requests", "requests", 1.0), ("reqursts", "requests", 11 / 12), ("abcd", "wxyz", 0.0), ("", "x", 0.0)])
def test_jaro(a, b, j):
    assert heuristics.jaro(a, b) == pytest.approx(j)


def test_typosquatting(spark):
    n = spark.createDataFrame([("requests",), ("reqeusts",), ("unlike",), (None,)], "name string")
    got = {r.name: r.result for r in heuristics.typosquatting(n, "name", ["requests", "numpy"]).collect()}
    assert got == {"requests": "PASS", "reqeusts": "FAIL", "unlike": "PASS", None: "SKIP"}
    with pytest.raises(ValueError):
        heuristics.typosquatting(n, "name", ["a"] * 5, most=4)


@settings(max_examples=100, deadline=None)
@given(st.text("abcde", max_size=9), st.text("abcde", max_size=9))
def test_length_filter_loses_no_similar_pair(a, b):
    if heuristics.name_ratio(a, b) >= 0.95:
        assert min(len(a), len(b)) >= (3 * 0.35 / 0.4 - 2) * max(len(a), len(b))


def test_rule_probability(spark):
    base = dict.fromkeys(heuristics.rule_names(), "PASS") | dict.fromkeys(("empty_project_link", "closer_release_join_date", "suspicious_setup", "wheel_absence"), "FAIL")
    rows = [base | {"k": 1, "one_release": "FAIL"}, base | {"k": 2}, base | {"k": 3, "suspicious_setup": "PASS", "high_release_frequency": "FAIL", "unchanged_release": "FAIL"}, dict.fromkeys(base, "SKIP") | {"k": 4}]
    got = {r.k: (r.probability, r.triggered) for r in heuristics.rule_probability(spark.createDataFrame(rows), "k").collect()}
    assert got == {1: (1.0, ["high_1"]), 2: (0.0, []), 3: (0.7, ["medium_1"]), 4: (0.0, [])}


def test_gates_and_texts(spark):
    w = spark.createDataFrame([(1, "FAIL", "FAIL"), (2, "PASS", "FAIL")], "k int, empty_project_link string, source_code_repo string")
    assert {r.k: r.source_code_repo for r in heuristics.gate(w).collect()} == {1: "SKIP", 2: "FAIL"}
    assert vals(spark, ["a@b.co", "a@b", "", None], heuristics.fake_email) == ["PASS", "FAIL", "SKIP", "SKIP"]
    assert vals(spark, ["A Placeholder.", "placeholders", None], heuristics.description_intent) == ["PASS", "FAIL", "FAIL"]
    assert vals(spark, ["import base64x\nfrom os import x", "import os", None], lambda c: heuristics.suspicious_setup(heuristics.python_imports(c))) == ["FAIL", "PASS", "SKIP"]


@pytest.mark.parametrize(("epoch", "v", "kind", "result"), [(0, (2024, 3, 7), "calendar", "PASS"), (4, (24, 7, 3), "calendar", "FAIL"), (0, (2024, 50, 0), "calendar_semantic", "FAIL"), (0, (3, 5, 24), "calendar", "PASS"), (0, (20240305, 0, 0), "calendar", "PASS"), (0, (50324, 0, 0), "calendar", "PASS"), (0, (21, 0, 0), "semantic", "FAIL"), (0, (20, 99, 0), "semantic", "PASS")])
def test_anomalous_version(spark, epoch, v, kind, result):
    at = F.lit("2024-03-05").cast("date")
    r = val(spark, heuristics.anomalous_version(F.lit(epoch), *map(F.lit, v), at, F.lit(True)))
    assert (r.kind, r.result) == (kind, result)


def test_noisy_or_grows(spark):
    d = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 0.2)], "k int, p double")
    assert {r.k: r.probability for r in heuristics.noisy_or(d, "k", "p").collect()} == {1: 0.75, 2: 1.0}


# Checks --------------------------------------------------------------------------------------------------------------


def test_registry_rules():
    reg = checks.Registry()
    with pytest.raises(ValueError):
        reg.register("bad-id")
    reg.register("mcn_a_1", depends_on=(("mcn_b_1", "PASSED"),))(lambda d: d)
    with pytest.raises(ValueError):
        reg.order()
    reg.register("mcn_b_1", depends_on=(("mcn_a_1", "PASSED"),))(lambda d: d)
    with pytest.raises(ValueError):
        reg.order()
    with pytest.raises(ValueError):
        reg.register("mcn_a_1")


def test_decisions(spark):
    ladder = lambda *a: val(spark, checks.maintainability(*[F.lit(x) if x is not None else F.lit(None).cast("int" if i > 1 else "boolean") for i, x in enumerate(a)]))
    assert [ladder(*a).result_type for a in ((True, False, 1, 1), (False, True, 1, 1), (False, None, 400, 10), (False, None, 400, None), (False, None, 10, 400), (False, None, 10, None))] == ["FAILED", "FAILED", "PASSED", "FAILED", "FAILED", "PASSED"]
    assert ladder(False, None, 10, None).confidence == 0.7
    assert [val(spark, checks.nearest_level(F.lit(x))) for x in (1.0, 0.85, 0.84, 0.55, 0.5, 0.0)] == [1.0, 1.0, 0.7, 0.7, 0.4, 0.4]
    assert val(spark, checks.license_decision(F.lit(None).cast("string"), (), True)).result_type == "FAILED"
    assert [val(spark, checks.scm_verdict(F.lit(g).cast("string"), F.lit("me"), F.lit(p).cast("string"), F.lit(x))) for g, p, x in (("org.a", None, True), (None, "x.y", False), ("com.github.me", None, False), ("org.a", None, False), ("org.a", "org.b", False), ("org.a.x", "org.a.y", False))] == ["PASSED", "UNKNOWN", "PASSED", "UNKNOWN", "FAILED", "PASSED"]


def test_dirs_and_summary(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a/b"), (1, "ab"), (2, "a/b/c"), (2, "a/b")], "k int, p string")
    assert {tuple(r) for r in checks.outermost_directories(d, "k", "p").collect()} == {(1, "a"), (1, "ab"), (2, "a/b")}
    r = spark.createDataFrame([("PASSED",), ("FAILED",), ("PASSED",)], "result_type string")
    assert tuple(checks.status_summary(r).first()) == (2, 1, 0, 0, 0)


# Workflows, dataflow, tags -------------------------------------------------------------------------------------------


def test_remote_execution_and_injection(spark):
    some = lambda f: lambda c: F.size(f(c)) > 0
    # A wrapper counts if the word right behind it is a shell; only plain words and only the first pipe of a pipeline count.
    t = ["curl -s x | bash", "wget -qO- x | sudo bash -", "/usr/bin/CURL x |& env sh", "set -e; curl x \\\n  -o - | tar xz", "if true; then curl x | bash; fi"]
    assert vals(spark, t, some(workflow.remote_scripts)) == [True] * 5
    t = ["wget x | sudo -E bash", "curl x | env A=1 sh", "curl x > f && bash f", "echo curl | bash", "curl x | grep bash", 'curl "x" | bash', "curl $U | bash", "curl x | tee f | bash", "# curl x | bash", "curl x || bash"]
    assert vals(spark, t, some(workflow.remote_scripts)) == [False] * 10
    t = ["echo ${{ github.event.issue.body }}", "x ${{ format('{0}', github.head_ref) }} && ls", "a | b '${{ github.event.comment.body }}'"]
    assert vals(spark, t, some(workflow.injections)) == [True] * 3
    t = ["echo ${{ github.event.issue.title }}", "echo ${{ github.sha }}", "github.head_ref", "X=${{ github.head_ref }}", "# echo ${{ github.head_ref }}", None]
    assert vals(spark, t, lambda c: F.coalesce(some(workflow.injections)(c), F.lit(False)) & F.coalesce(F.size(workflow.injections(c)) > 0, F.lit(False))) == [False] * 6
    assert vals(spark, ["${{ github.a.b }} ${{ github.a.b && secrets.K }}"], workflow.expressions) == [["github.a.b"]]
    assert vals(spark, ["${{ secrets.K }}${{ secrets.L }}"], workflow.secrets_used) == [["K", "L"]]


def test_shell(spark):
    script = 'A=x\nif test; then A=y; fi\nB="$A-1"\necho "$B" > ./out.txt\nC=$(echo aGk= | base64 -d)\necho "mvn deploy" > run.sh && bash run.sh\necho Z2l0IHB1c2g= | base64 --decode | sh\n'
    d = dataflow.interpret_scripts(spark.createDataFrame([(1, script), (2, None), (3, "bash a.sh"), (4, "echo 'bash b.sh' > b.sh; bash b.sh")], "id long, s string"), "id", "s")
    rows = [tuple(r)[1:] for r in d.where("id = 1").collect()]
    assert {v for k, n, v in rows if (k, n) == ("variable", "B")} == {"x-1", "y-1"} == {v for k, n, v in rows if (k, n) == ("file", "out.txt")}
    assert ("variable", "C", "hi") in rows and "mvn deploy" in {v for k, _, v in rows if k == "command"} and "git push" in {v for k, _, v in rows if k == "command"}
    assert d.where("id = 2").count() == 0


def test_fixpoint_on_a_loop(spark):
    e = spark.createDataFrame([(1, "a", "v", None, None), (2, "b", "", "./a", "!")], "node long, location string, prefix string, source string, suffix string")
    flow = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert {tuple(r) for r in dataflow.fixpoint(e, flow).collect()} == {(n, loc, v) for n in (1, 2) for loc, v in (("a", "v"), ("b", "v!"))}
    grow = spark.createDataFrame([(1, "a", "v", None, None), (2, "a", "x", "a", "")], "node long, location string, prefix string, source string, suffix string")
    with pytest.raises(graph.NoFixpoint):
        dataflow.fixpoint(grow, flow, max_rounds=6)


def test_bindings_scopes_edges(spark):
    b = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (2, "x", "1"), (2, "x", "2")], "alt int, n string, v string")
    assert [(r.alt, r.bindings) for r in dataflow.consistent_choices(b, "alt", "n", "v").collect()] == [(1, {"x": "1", "y": "2"})]
    i = spark.createDataFrame([(1, 2, 3, 4), (5, 6, None, 7)], "cond int, then_node int, else_node int, exit_node int")
    assert {tuple(r) for r in dataflow.branch_edges(i).collect()} == {(1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (5, 7), (6, 7)}
    s = spark.createDataFrame([(1, "d/e/f", "v")], "node int, location string, value string")
    assert dataflow.files_under(s, spark.createDataFrame([(9, 1, "d"), (8, 1, "e")], "read int, node int, directory string")).collect()[0].read == 9
    assert dataflow.secrets_reached(spark.createDataFrame([(1, "l", "secrets.K")], "node int, location string, value string")).first().secret == "K"


@pytest.mark.parametrize(("version", "name", "given", "best"), [("1.2.3", "lib", ["v1.2.3", "v1.2.3-rc1", "1.2"], "v1.2.3"), ("1.2.3", "lib", ["lib-1_2_3", "other-1.2.3"], "lib-1_2_3"), ("2.3", "lib", ["1.2.3"], None), ("1.0", "lib", ["release/1.0", "x"], "release/1.0"), ("1.0", "lib", ["1.0.1"], "1.0.1")])
def test_tag_match(spark, version, name, given, best):
    v = spark.createDataFrame([("r", name, version)], "repo string, name string, version string")
    t = spark.createDataFrame([("r", x) for x in given], "repo string, tag string")
    got = [r.tag for r in tags.match_tags(v, t).collect()]
    assert got == ([best] if best else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=2, max_size=4), st.sampled_from(["", "v", "release-", "lib-", "rel/"]), st.sampled_from([".", "_", "-"]))
def test_a_tag_made_from_a_version_scores_high(parts, prefix, sep):
    v = ".".join(map(str, parts))
    assert tags.score(v, "lib", prefix + sep.join(map(str, parts))) >= 0.8


def test_find_commit(spark):
    p = spark.createDataFrame([("r", "n", "abcdef1"), ("r", "n", "v1"), ("r", "n", "v1.0.0-20240102030405-abcdef123456"), ("r", "n", "2.0"), ("r", "n", "9")], "repo string, name string, version string")
    t = spark.createDataFrame([("r", "v1", "c1"), ("r", "v2.0", "c2")], "repo string, tag string, commit string")
    got = {r.version: (r.commit, r.outcome) for r in tags.find_commit(p, t).collect()}
    assert got["abcdef1"] == ("abcdef1", "hash") and got["v1"] == ("c1", "tag") and got["2.0"] == ("c2", "matched") and got["9"] == (None, "no_match")
    assert got["v1.0.0-20240102030405-abcdef123456"] == ("abcdef123456", "pseudo_version")


# Builds, provenance, readers, sinks ----------------------------------------------------------------------------------


def test_build_helpers(spark):
    assert vals(spark, ["Generator: bdist_wheel (0.40.0)", "flit 3.9", "setuptools (75)", "?"], lambda c: build_spec.wheel_generator(c))[0].backend == "wheel"
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    p = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))
    assert val(spark, build_spec.patch_options(m, p)) == {"b": "2", "c": "3"}
    cmd = F.array(F.lit("/usr/bin/mvn"), F.lit("-q"), F.lit("deploy"))
    assert val(spark, build_spec.command_uses(cmd, ("mvn",), ("deploy",))) and not val(spark, build_spec.command_uses(cmd, ("mvn",), ("test",)))
    f = spark.createDataFrame([(1, "z/pom.xml"), (1, "a/b/pom.xml"), (1, "README")], "k int, p string")
    assert build_spec.first_config(f, "k", "p", ("pom.xml",)).first().p == "z/pom.xml"


def test_commands():
    p = patterns.parse_command("mvn -f a.xml clean install -DskipTests -Dx=1 -P prod --threads=2")
    assert p["goals"] == ["clean", "install"] and p["options"] == {"-f": "a.xml", "-P": "prod", "--threads": "2"} and p["properties"] == {"skipTests": "true", "x": "1"}
    assert patterns.parse_command("make") is None and patterns.parse_command("'") is None and patterns.parse_command("") is None


def test_provenance_dialects(spark):
    v1 = {"predicateType": "https://slsa.dev/provenance/v1", "predicate": {"buildDefinition": {"externalParameters": {"workflow": {"repository": "https://h/o/n"}}, "resolvedDependencies": [{"uri": "git+https://h/x/y@refs/heads/m", "digest": {"gitCommit": "0"}}, {"uri": "git+https://h/o/n@refs/tags/v1", "digest": {"gitCommit": "1"}}]}}}
    v02 = {"predicateType": "https://slsa.dev/provenance/v0.2", "predicate": {"invocation": {"configSource": {"uri": "git+https://h/o/n@refs/heads/main", "digest": {"sha1": "2"}}}}}
    v01 = {"predicateType": "https://slsa.dev/provenance/v0.1", "predicate": {"recipe": {"definedInMaterial": 0}, "materials": [{"uri": "git+https://h/o/n", "digest": {"sha1": "3"}}]}}
    d = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate((v1, v02, v01, {}))], "i int, p string").select("i", provenance.statement(F.col("p")).alias("v"))
    got = {r.i: (r.repository, r.commit) for r in provenance.source_of(d).collect()}
    assert got == {0: ("https://h/o/n", "1"), 1: ("https://h/o/n", "2"), 2: ("https://h/o/n", "3"), 3: (None, None)}


def test_readers(spark, tmp_path):
    (tmp_path / "edge.facts").write_text("1\t2\n2\t3\n")
    assert readers.read_relation(spark, str(tmp_path / "edge.facts"), "x long, y long").count() == 2
    (tmp_path / "p.txt").write_text("b\n\na\n")
    assert [r.name for r in readers.read_popular_names(spark, str(tmp_path / "p.txt")).orderBy("rank").collect()] == ["b", "a"]
    with gzip.open(tmp_path / "prov.jsonl.gz", "wt") as h:
        h.write(json.dumps({"payload": "abc"}) + "\nbroken\n")
    assert [r.payload for r in readers.read_provenance(spark, str(tmp_path / "prov.jsonl.gz")).collect()] == ["abc"]
    spark.range(2).write.parquet(str(tmp_path / "db" / "_t.parquet"))
    rel = readers.read_fact_store(spark, str(tmp_path / "db"))
    assert list(rel) == ["t"] and spark.table("t").count() == 2 and "decl t(id: symbol)" in readers.declarations(rel)
    pom = "<project xmlns='http://maven.apache.org/POM/4.0.0'><parent><groupId>g</groupId><version>1</version></parent><artifactId>a</artifactId><scm><url>u</url></scm></project>"
    assert tuple(val(spark, readers.pom_coordinates(F.lit(pom)))) == ("g", "a", "1", "u")
    assert val(spark, readers.resolve_properties(F.lit("${a}/${z}"), F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("x")))) == "x/${z}"
    assert val(spark, readers.gradle_property(F.lit("rootProject.name = 'demo'\ngroup = \"g\""), "group")) == "g"
    assert val(spark, readers.page_links(F.lit("<a class=x href='u'>1</a><A HREF=\"v\">"))) == ["u", "v"]
    assert readers.local_artifacts(spark, str(tmp_path), "*.facts").first().sha256


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "mcn_a_1", True), (1, "mcn_b_1", False)], "component_id int, check_id string, passed boolean")
    assert json.loads(sinks.json_report(d, "component_id").first().report)["results"][1] == {"check_id": "mcn_b_1", "passed": False}
    sinks.append_facts(d, str(tmp_path / "f"))
    sinks.append_facts(d, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("check_id = 'mcn_a_1'").count() == 2
    sinks.write_relations({"r": d}, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o" / "r"), sep="\t").count() == 2
    assert sinks.markdown_rows(d.withColumn("check_id", F.lit("a|b")), ["check_id"], ["component_id"]).first().line == r"| a\|b |"


def test_relational(spark):
    a = spark.createDataFrame([(1, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    assert {(r.k, r.v, r.source_rank) for r in relational.fallback_chain([a, b], "k").collect()} == {(1, 1, 0), (2, 3, 1)}
    d = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, s string")
    assert {tuple(r) for r in relational.single_or_null(d, "k", "s").collect()} == {(1, "x"), (2, None)}
    assert relational.existing_columns(d, ["s", "nope"]).columns == ["s"] and relational.resolve_table(spark, "nope") is None
    f = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 2, None)], "node int, parent int, kind string").withColumn("kind", F.when(F.col("node") == 1, "job").otherwise("step"))
    assert {tuple(r) for r in resolution.nearest_ancestor(f, "job").collect()} == {(1, 1), (2, 1), (3, 1)}


def test_workflow_documents(spark):
    doc = {"on": {"pull_request_target": {}}, "permissions": {"contents": "write", "issues": "read"}, "jobs": {"b": {"permissions": {"contents": "write"}, "runs-on": "self-hosted", "steps": [{"id": "c", "uses": "actions/checkout@v4", "with": {"ref": "${{ github.head_ref }}"}}, {"run": "make"}]}, "empty": {}}}
    docs = [json.dumps(doc), json.dumps({"on": ["push"], "permissions": "read-all", "jobs": {"a": {"steps": [{"run": "x"}]}}}), json.dumps({"on": "push", "jobs": {"a": {"steps": [{"run": "x"}]}}}), "{", None]
    s = workflow.flatten(spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "p string, d string"), "p", "d")
    rows = {(r.workflow, r.step): r for r in s.collect()}
    assert set(rows) == {("0", "c"), ("0", "step1"), ("1", "step0"), ("2", "step0")}
    assert rows["0", "c"].triggers == ["pull_request_target"] and rows["0", "c"].job_permissions == "contents: write" and rows["1", "step0"].workflow_permissions == "read-all" and rows["2", "step0"].triggers == ["push"]
    found = {(r.workflow, r.finding) for r in workflow.step_findings(s).collect()}
    assert {("0", "overbroad-permissions"), ("0", "self-hosted-runner"), ("0", "pr-target-untrusted-checkout"), ("0", "privileged-trigger"), ("0", "unpinned-third-party-action")} == found


def test_texts(spark):
    assert vals(spark, ["aGk=", "aGk", "a", "!!", "/w==", None], tx.decode_base64) == ["hi", "hi", None, None, None, None]
    assert vals(spark, ["a/b/", "c"], tx.basename) == ["b", "c"]
    assert vals(spark, ["run 'a b' \"c\"d e"], tx.quoted_words) == [["run", "a b", "cd", "e"]]
    assert vals(spark, ["x/deploy-prod.yml", "undeployed.yml", "test_release.yml"], lambda c: tx.deploy_evidence(c, F.lit(True))) == [1.0, 0.7, 0.7]
    assert vals(spark, ["a.b.c"], lambda c: tx.split_literal(c, ".")) == [["a", "b", "c"]]
    assert val(spark, tx.best_effort(F.unhex(F.lit("E9")))) == "é" and val(spark, tx.concat_capped(F.lit("x"), F.repeat(F.lit("y"), 10_000))) is None
    f = spark.createDataFrame([(1, "pom.xml"), (1, "a/b/c.java"), (1, "a/pom.xml"), (2, "x/y")], "k int, p string")
    assert {(r.k, r.p): r.found for r in readers.nearest_file_above(f, "k", "p", "pom.xml").collect()} == {(1, "pom.xml"): "pom.xml", (1, "a/b/c.java"): "a/pom.xml", (1, "a/pom.xml"): "a/pom.xml"}
