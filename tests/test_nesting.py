"""Problem 5 by cases."""

import base64
import json

from lodeworks.operators import nesting as n

DOC = {
    "metadata": {"component": {"name": "r", "hashes": {"alg": "x", "content": "h0"}}, "tools": {"components": [{"name": "t", "hashes": [{"content": "ht"}]}]}},
    "components": [
        {"name": "a", "externalReferences": [{"url": None}, {"url": "u1", "hashes": [{"content": "hu"}]}], "components": {"name": "b", "hashes": [None, {"content": "hb"}]}},
        {"name": "c", "hashes": [], "externalReferences": None},
    ],
}


def leaves(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    rel = n.relations(df, "id", "t", n.BOM, {"hashes", "externalReferences"})
    return sorted(tuple(r)[1:] for r in n.leaves(rel, "s", {"hashes": "content", "externalReferences": "url"}).collect())


def test_paths_positions_and_lone_objects(spark):
    assert leaves(spark, [json.dumps(DOC)]) == [
        (0, "components[0]", "externalReferences", 1, "u1"),
        (0, "components[0].components[0]", "hashes", 1, "hb"),
        (0, "components[0].externalReferences[1]", "hashes", 0, "hu"),
        (0, "metadata.component", "hashes", 0, "h0"),
        (0, "metadata.tools.components[0]", "hashes", 0, "ht"),
    ]


def test_documents_that_give_no_rows(spark):
    text = json.dumps(DOC)
    assert leaves(spark, [None, "", "  ", "[]", "3", text[:-1], text + "x", '{"a": NaN}', "not base64!"]) == []
    assert leaves(spark, []) == []


def test_repeated_documents_keep_their_own_rows(spark):
    assert len(leaves(spark, [json.dumps(DOC)] * 2)) == 10


def test_statement_digests_in_any_coding(spark):
    s = {"subject": [{"name": "x", "digest": {"sha256": "1", "sha512": "2", "md5": None}}], "predicate": {"invocation": {"configSource": {"digest": {"sha1": "3"}}}, "materials": {"uri": "u", "digest": {"sha1": "4"}}}}
    raw = json.dumps(s).encode()
    std = base64.b64encode(raw).decode()
    forms = [raw.decode(), std, std.rstrip("="), base64.urlsafe_b64encode(raw).decode(), "\n".join(std[i : i + 20] for i in range(0, len(std), 20)), std[: len(std) // 2]]
    df = spark.createDataFrame(list(enumerate(forms)), "id long, t string")
    out = n.leaves(n.relations(df, "id", "t", n.STATEMENT, {"digest"}), "a", {}, ("digest",)).collect()
    want = {("subject[0]", "digest.sha256", "1"), ("subject[0]", "digest.sha512", "2"), ("predicate.invocation.configSource", "digest.sha1", "3"), ("predicate.materials[0]", "digest.sha1", "4")}
    for k in range(5):
        assert {(r.parent_path, r.child_kind, r.child_value) for r in out if r.rec_id == k} == want
    assert not [r for r in out if r.rec_id == 5]


def test_shared_inlining():
    e = n._edges({"": "a b* c", "a": "d", "c": "d e", "e": "f", "b": "g", "g": "b*"})
    p = n.shared_inlining(e)
    assert p.tables == {"b", "d", "g"} and p.repeated == {"b"}


def test_inlining_and_links(spark):
    df = spark.createDataFrame([(7, json.dumps({"x": {"y": 1}, "components": [{"name": "a", "path": "p", "author": {"org": "n"}, "hashes": [{"content": "h"}]}]}))], "id long, t string")
    rel = n.relations(df, "id", "t", n.BOM)
    rows = {r.path: r for r in rel.collect()}
    assert rows[""].columns == {"x.y": "1"}
    assert rows["components[0]"].columns == {"name": "a", "path": "p", "author.org": "n"} and rows["components[0]"].parent_row == ""
    assert rows["components[0].hashes[0]"].parent_row == "components[0]"
    t = n.table(rel, "components", ["name", "path", "absent"]).first()
    assert (t.rec_id, t.path, t.path_, t.absent) == (7, "components[0]", "p", None)


def test_inferred_graph(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), (None,), ("{",)], "t string")
    g = {(e.parent, e.child): e.repeated for e in n.infer_graph(df, "t")}
    assert g["", "components"] and g["components", "hashes"] and not g["metadata", "component"]


def test_deep_and_large_documents(spark):
    d = {"name": "leaf", "hashes": [{"content": "deep"}]}
    for _ in range(150):
        d = {"components": [d]}
    wide = {"components": [{"hashes": [{"content": str(i)}]} for i in range(30_000)]}
    assert leaves(spark, [json.dumps(d)])[0][1].count("components") == 150
    assert len(leaves(spark, [json.dumps(wide)])) == 30_000


def test_any_depth_and_broken_deep_documents(spark):
    depth = 20_000
    deep = '{"components":[' * depth + '{"hashes":[{"content":"x"}]}' + "]}" * depth
    doc = n.document(deep)
    assert doc is not None and n.document(deep[:-1]) is None and n.document(deep + "]") is None
    rows = [r for r in n.rows_of(doc, n.shared_inlining(n.BOM), frozenset({"hashes"}))]
    assert [r.columns for r in rows] == [{"content": "x"}] and rows[0].parent_path.count("components[0]") == depth
    assert n.infer_graph(spark.createDataFrame([(deep,)], "t string"), "t") != []


def test_the_loop_reads_what_the_decoder_reads():
    good = ['{}', '[]', ' {"a" : [1, -2.50e3, true, false, null, "x\\u00e9\\n", {"b": {}}, [], [[1]]] , "c":"" } ', '{"a":1,"a":2}', "3", '"s"']
    for t in good:
        assert n._deep(t) == n._DECODER.decode(t.strip())
    for t in ["", "{", '{"a"}', '{"a":}', "[1,]", "[1 2]", '{"a":1,}', "01", "nul", "[1]]", '{"a":1}{"b":2}', "-", '{1:2}', '["x]']:
        for read in (n._deep, n._DECODER.decode):
            try:
                read(t)
            except ValueError:
                continue
            raise AssertionError(t)


def test_numbers_stay_as_written(spark):
    df = spark.createDataFrame([(1, '{"components": [{"name": "a", "size": 1.50, "n": 12345678901234567890123, "e": 1E5, "b": true}]}')], "id long, t string")
    row = n.relations(df, "id", "t", n.BOM, {"components"}).first()
    assert row.columns == {"name": "a", "size": "1.50", "n": "12345678901234567890123", "e": "1E5", "b": "true"}


def test_typed_columns_give_the_tables_of_their_json(spark):
    kind = "id long, affected array<struct<package struct<name string>, ranges array<struct<type string, events array<struct<introduced string>>>>>>"
    rows = [
        (1, [{"package": {"name": "p"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}]}, None, {"type": None, "events": None}]}, None, {"package": None, "ranges": []}]),
        (2, None), (3, []), (1, [{"package": None, "ranges": [{"type": "ECO", "events": []}]}]),
    ]
    df = spark.createDataFrame(rows, kind)
    edges = n.schema_graph(df.schema)
    for name, column in (("ranges", "type"), ("affected", "package.name"), ("events", "introduced")):
        typed = n.typed_table(df, "id", ["affected"], name).select("rec_id", "path", "parent_row", "parent_path", "pos", f"`{column}`")
        rel = n.relations(df.selectExpr("id", "to_json(struct(affected)) AS t"), "id", "t", edges, {name})
        assert sorted(map(tuple, typed.collect()), key=str) == sorted(map(tuple, n.table(rel, name, [column]).collect()), key=str)
    assert n.typed_table(df.limit(0), "id", ["affected"], "ranges").count() == 0


def test_the_graph_of_the_data_completes_the_declared_one(spark):
    df = spark.createDataFrame([('{"vendorParts": [{"parts": {"hashes": {"content": "1"}}}], "components": {"name": "x"}}',)], "t string")
    edges = n.graph_of(df, "t", n.BOM)
    assert n.Edge("", "vendorParts", True) in edges and n.Edge("", "components", True) in edges
    rel = n.relations(df.selectExpr("1 AS id", "t"), "id", "t", edges, {"hashes"})
    assert rel.first().parent_path == "vendorParts[0].parts"


def test_unreadable_documents_are_listed(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "{"), (4, "{}"), (5, "[1]")], "id long, t string")
    assert sorted(map(tuple, n.unreadable(df, "id", "t").collect())) == [(1, "null"), (2, "empty"), (3, "broken"), (5, "broken")]
