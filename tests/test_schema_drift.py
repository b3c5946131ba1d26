"""Problem 4 by cases."""

import json

from lodeworks.operators import schema_drift as sd

SCHEMA = "feed string, file_seq long, line string, v string"


def lines(spark, files, feed="f"):
    rows = []
    for seq, recs in files.items():
        for r in recs:
            rows.append((feed, seq, r if isinstance(r, str) or r is None else json.dumps(r), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted((r.producer, r.seq, r.change, r.field, r.new_field) for r in sd.changes(df).collect())


def test_added_removed_renamed_and_type(spark):
    df = lines(spark, {
        1: [{"ref": "a", "x": 1, "old": "p", "gone": True}, {"ref": "b", "x": 2, "old": "q", "gone": False}],
        3: [{"ref": "a", "x": "1", "new": "p"}, {"ref": "b", "x": 2, "new": "q"}, {"ref": "c", "new": "r", "more": []}],
    })
    assert changes(df) == [("f", 3, "added", "more", ""), ("f", 3, "removed", "gone", ""), ("f", 3, "renamed", "old", "new"), ("f", 3, "type_changed", "x", "")]


def test_a_field_that_comes_and_goes(spark):
    df = lines(spark, {1: [{"ref": "a", "k": 1}], 2: [{"ref": "a"}], 3: [{"ref": "a", "k": 1}], 4: [{"ref": "a", "k": None}]})
    assert changes(df) == [("f", 2, "removed", "k", ""), ("f", 3, "added", "k", ""), ("f", 4, "removed", "k", "")]
    spans = sorted((r.field, r.first_seq, r.last_seq, r.files) for r in sd.lifespans(sd.catalogue(df)).collect())
    assert spans == [("k", 1, 1, 1), ("k", 3, 3, 1), ("ref", 1, 4, 4)]


def test_broken_lines_nulls_and_case(spark):
    good = {"ref": "a", "k": 1}
    df = lines(spark, {1: [good, good, None, "", "{", '{"z": 1', '{"z": 1} tail', '{"y": 1}{"z": 2}', '{"y": 1},{"z": 2}', "[1]", '"s"', '{"n": null}'], 2: [{"ref": "a", "K": 1}]})
    assert changes(df) == [("f", 2, "renamed", "k", "K")]


def test_a_file_of_broken_lines_only(spark):
    df = lines(spark, {1: [{"ref": "a", "k": 1}], 2: ["{"], 3: [{"ref": "a", "k": 1}]})
    assert changes(df) == [("f", 2, "removed", "k", ""), ("f", 2, "removed", "ref", ""), ("f", 3, "added", "k", ""), ("f", 3, "added", "ref", "")]


def test_swapped_values_are_no_rename(spark):
    df = lines(spark, {1: [{"ref": "a", "k": 1}, {"ref": "b", "k": 2}], 2: [{"ref": "a", "m": 2}, {"ref": "b", "m": 1}]})
    assert changes(df) == [("f", 2, "added", "m", ""), ("f", 2, "removed", "k", "")]


def test_one_file_and_empty_table(spark):
    df = lines(spark, {1: [{"ref": "a", "k": 1}]})
    assert changes(df) == [] and changes(df.limit(0)) == []


def test_null_producer_is_left_out(spark):
    df = lines(spark, {1: [{"ref": "a"}], 2: [{"ref": "a", "k": 2}]}, feed=None)
    assert changes(df) == []


def table_of(df):
    drift = sd.Drift(df)
    aliases = sd.Aliases(drift.changes(), drift.catalogue)
    return aliases, sd.unified(df, aliases).orderBy("feed", "file_seq").collect()


def test_one_table(spark):
    df = lines(spark, {1: [{"ref": "a", "size": 1, "n": "x", "feed": "q"}], 2: [{"ref": "a", "bytes": 1, "n": {"v": 1}}]})
    aliases, rows = table_of(df)
    assert aliases.fields["bytes"] == ["bytes", "size"] and aliases.types["bytes"] == "bigint"
    assert [r["bytes"] for r in rows] == [1, 1] and rows[0]["n"] == "x" and json.loads(rows[1]["n"]) == {"v": 1}
    assert rows[0]["feed_"] == "q" and rows[0]["feed"] == "f"


def test_a_rename_in_one_feed_takes_nothing_from_another_that_has_both_fields(spark):
    a = lines(spark, {1: [{"ref": "a", "ver": "1"}], 2: [{"ref": "a", "version": "1"}], 3: [{"ref": "a", "version": "2"}], 4: [{"ref": "z"}, {"ref": "a", "version": "3"}]}, "a")
    b = lines(spark, {1: [{"ref": "x", "ver": "old", "version": "new"}, {"ref": "y", "ver": "only"}], 2: [{"ref": "x", "ver": "later"}]}, "b")
    df = a.union(b)
    aliases, rows = table_of(df)
    assert aliases.fields["version"] == ["version", "ver"]
    got = {(r["feed"], r["file_seq"], r["version"], r["ver"]) for r in rows if r["version"] or r["ver"]}
    assert got == {("a", 1, "1", None), ("a", 2, "1", None), ("a", 3, "2", None), ("a", 4, "3", None), ("b", 1, "new", "old"), ("b", 1, None, "only"), ("b", 2, "later", None)}
    long = {(r.feed, r.file_seq, r.column, r.value) for r in sd.long_values(df.withColumnRenamed("v", "id"), aliases, "id").collect()}
    assert {("b", 1, "ver", "old"), ("b", 1, "version", "new"), ("b", 2, "version", "later")} <= long


def test_numbers_keep_every_digit(spark):
    big = 2**53 + 1
    df = lines(spark, {1: [f'{{"ref": "a", "n": {big}, "d": 1.25, "m": 10000000000000000001, "e": 1e3, "mixed": 1.5}}'], 2: [f'{{"ref": "b", "n": 3, "d": 12345678901234567, "m": 1, "e": 2.5, "mixed": {big}}}', '{"ref": "c", "mixed": 1e-3}']})
    aliases, rows = table_of(df)
    assert aliases.types["n"] == "bigint" and rows[0]["n"] == big
    assert aliases.types["d"].startswith("decimal") and str(rows[0]["d"]) == "1.25" and int(rows[1]["d"]) == 12345678901234567
    assert int(rows[0]["m"]) == 10000000000000000001
    assert aliases.types["e"] == "double" and rows[0]["e"] == 1000.0
    assert aliases.types["mixed"] == "string" and {r["mixed"] for r in rows} >= {"1.5", str(big)}


def test_fields_with_equal_values_are_matched_one_to_one(spark):
    df = lines(spark, {1: [{"ref": "a", "p": 1, "q": 1}, {"ref": "b", "p": 1, "q": 1}], 2: [{"ref": "a", "x": 1, "y": 1}, {"ref": "b", "x": 1, "y": 1}]})
    assert changes(df) == [("f", 2, "renamed", "p", "x"), ("f", 2, "renamed", "q", "y")]


def test_one_of_two_types_ends(spark):
    df = lines(spark, {1: [{"ref": "a", "k": 1}, {"ref": "b", "k": "x"}], 2: [{"ref": "a", "k": 1}], 3: [{"ref": "a", "k": True}]})
    assert changes(df) == [("f", 2, "type_changed", "k", ""), ("f", 3, "type_changed", "k", "")]


def test_long_line(spark):
    df = lines(spark, {1: [{"ref": "a", "k": "x" * 300_000}], 2: [{"ref": "a", "m": "x" * 300_000}]})
    assert changes(df) == [("f", 2, "renamed", "k", "m")]


def test_one_key_for_all_records(spark):
    df = lines(spark, {1: [{"ref": "a", "k": i} for i in range(300)], 2: [{"ref": "a", "m": i} for i in range(300)]})
    assert changes(df) == [("f", 2, "renamed", "k", "m")]
