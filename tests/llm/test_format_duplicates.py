"""Problem 3 against brute force and by cases."""

import random
import re
from collections import defaultdict
from urllib.parse import unquote

from lodeworks.llm import format_duplicates as fd

SCHEMA = "row_id long, g string, n string, p string, key string, id string"
F3 = ["g", "n", "p"]


def words(t):
    return " ".join(re.findall(r"[^\W_]+", unquote(t or "").lower()))


def brute(rows):
    sets = defaultdict(list)
    for i, g, n, p in rows:
        base, _, tail = (p or "").partition("?")
        pairs = sorted((words(x.partition("=")[0]), words(x.partition("=")[2])) for x in tail.split("&") if words(x))
        sets[words(g), words(n), words(base), tuple(pairs)].append(i)
    return {(min(s), x) for s in sets.values() for x in s if x != min(s)}, {min(s): len(s) for s in sets.values()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = random.Random(3)
    bases = [("org.a", f"x-{i % 5}", f"pkg:maven/org.a/x-{i % 5}@1.{i % 3}?type=jar&classifier=s{i % 2}") for i in range(30)] + [(None, "y", "pkg:npm/%40s/y@1.23"), (" ", "y", "pkg:npm/@s/y@1.2.3")]

    def dirty(t):
        if t is None:
            return rng.choice([None, "", " ", "-"])
        if "?" in t and rng.random() < 0.5:
            a, b = t.split("?")
            t = a + "?" + "&".join(reversed(b.split("&")))
        t = "".join(c.upper() if rng.random() < 0.3 else c for c in t)
        return rng.choice(["", " ", "\t"]) + t.replace("-", rng.choice(["-", " ", "--", "_", "–"])) + rng.choice(["", " ", ".", "\n"])

    rows = [(i, *map(dirty, rng.choice(bases))) for i in range(2000)]
    pairs, counts = brute(rows)
    df = frame(spark, rows)
    assert {tuple(r) for r in fd.copies(df, "row_id", F3, {"p"}).collect()} == pairs
    assert {r.keep_id: r.n_copies for r in fd.collapse(df, "row_id", F3, {"p"}).collect()} == counts


def test_look_alikes_are_no_copies(spark):
    rows = [(1, "g", "n", "a@1.23"), (2, "g", "n", "a@1.2.3"), (3, "g", "n", "a?x=1&y=2"), (4, "g", "n", "a?x=2&y=1"), (5, "n", "g", "a@1.23"), (6, "gn", "", "a@1.23"), (7, "g", "n", "a?y=2&x=1"), (8, "g", "n", "a x 1 y 2"), (9, "g", "n", "a?x=1&x=1&y=2")]
    assert {tuple(r) for r in fd.copies(frame(spark, rows), "row_id", F3, {"p"}).collect()} == {(3, 7)}


def test_nulls_empty_long_and_repeated(spark):
    rows = [(1, None, None, None), (2, "", " ", "-"), (3, "g", "w " * 100_000, "p"), (4, "G", "W  " * 100_000, "P"), (5, "g", "n", "p"), (5, "g", "n", "p"), (6, "%zz", "100%", "%"), (7, "zz", "100", "")]
    got = sorted(tuple(r) for r in fd.copies(frame(spark, rows), "row_id", F3, {"p"}).collect())
    assert got == [(1, 2), (3, 4), (6, 7)]
    assert fd.copies(frame(spark, []), "row_id", F3, {"p"}).count() == 0
    assert fd.collapse(frame(spark, rows), "row_id", F3).where("n_copies = 2").count() == 4


def test_one_group_holds_most_rows(spark):
    df = spark.range(20_000).selectExpr("id row_id", "case when id % 3 = 0 then 'hot' else concat('g', id) end g", "'n' n", "null p", "'a' key", "'b' id")
    assert fd.copies(df, "row_id", F3, {"p"}).count() == 6666


def test_letter_case_is_lower_case_and_pairs_are_sorted(spark):
    assert fd.words("Straße") != fd.words("STRASSE") and fd.words("ÀB") == fd.words("àb")
    rows = [(i, f"n?{'&'.join(rng)}") for i, rng in enumerate([["a=1", "b=2", "c=3"], ["c=3", "a=1", "b=2"], ["a=1", "b=2"], ["b=2", "a=1", "c=4"], ["a=1"] * 2])]
    df = spark.createDataFrame(rows, "id long, p string")
    assert sorted(map(tuple, fd.copies(df, "id", ["p"], {"p"}).collect())) == [(0, 1)]
    assert fd.collapse(df, "id", ["p"], {"p"}).count() == 4


def test_keys_of_any_bytes_meet(spark):
    """Keys are raw bytes: many distinct sets, each of three, over and over."""
    df = spark.range(30_000).selectExpr("id row_id", "concat('g', id % 10000) g", "concat('n', id % 10000) n", "null p", "'a' key", "'b' id")
    for _ in range(3):
        out = fd.copies(df, "row_id", F3, {"p"})
        assert out.count() == 20_000 and out.where("copy_id % 10000 <> keep_id").count() == 0
