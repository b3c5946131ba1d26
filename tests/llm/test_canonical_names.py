"""Problem 1: the trie search against brute force, and cases."""

import random

import pytest

from lodeworks.llm import canonical_names as cn
from lodeworks.llm.queries import LICENSE_WORDS, NO_LICENSE_WORDS

WORDS = [*LICENSE_WORDS.items(), *((w, "") for w in NO_LICENSE_WORDS)]

LIST = [
    ("Quartzite-1.1", "Quartzite Community License 1.1"),
    ("Quartzite-2.0", "Quartzite Community License 2.0"),
    ("Driftwater-PL-2.0", "Driftwater Public License 2.0"),
    ("Driftwater-PL-2.0-or-later", "Driftwater Public License 2.0 or later"),
    ("Driftwater-NC-3.0", "Driftwater Noncommercial Public License 3.0"),
    ("Ostrander-LL", "Ostrander Library License"),
    ("Ostrander-NC", "Ostrander Noncommercial Library License"),
]


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_search_finds_what_brute_force_finds():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    t = cn.Trie()
    for i, w in enumerate(words):
        t.add(w, i)
    for _ in range(300):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        for k in (0, 1, 2):
            want = {i: d for i, w in enumerate(words) if (d := distance(q, w)) <= k}
            assert t.search(q, k) == want, (q, k)


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("quartzite 1.1", "Quartzite-1.1"),
        ("Quartzite1.1", "Quartzite-1.1"),
        ("The Quartzite Comm. Licence, Version 2", "Quartzite-2.0"),
        ("https://licenses.example/quartzite-1.1/;", "Quartzite-1.1"),
        ("https://licenses.example/ostrander-nc.html", "Ostrander-NC"),
        ("License :: Approved :: Qaurtziet Community Lic V.1.1", "Quartzite-1.1"),
        ("Community License, Quärtzite (v2.0) *", "Quartzite-2.0"),
        ("driftwater 2.0+", "Driftwater-PL-2.0-or-later"),
        ("Driftwater Public License 2 or any later version", "Driftwater-PL-2.0-or-later"),
        ("driftwaterpl2.0orlater", "Driftwater-PL-2.0-or-later"),
        ("driftwater v.2", "Driftwater-PL-2.0"),
        ("Driftwater Non-Commercial Public License 3", "Driftwater-NC-3.0"),
        ("ostradner", "Ostrander-LL"),
        ("Ostrander Noncommercial Library Licens (Ostrander-NC)", "Ostrander-NC"),
        ("Driftwater Public License 9.0", "NONE"),
        ("Driftwater", "NONE"),
        ("Jabberwock Public License 2.0", "NONE"),
        ("UNKNOWN", "NONE"),
        ("", "NONE"),
        ("   ", "NONE"),
        ("?!", "NONE"),
        ("x" * 200_000, "NONE"),
        ("word " * 50_000, "NONE"),
    ],
)
def test_cases(value, ref):
    assert cn.NameMatcher(LIST, WORDS).resolve(value) == ref


def test_every_entry_means_itself():
    m = cn.NameMatcher(LIST, WORDS)
    assert all(m.resolve(r) == r and m.resolve(f) == r for r, f in LIST)


def test_ambiguous_is_none():
    m = cn.NameMatcher([("Alphabeta-1.0", "Alphabeta 1.0"), ("Alphabetx-1.0", "Alphabetx 1.0")])
    assert m.resolve("alphabety 1.0") == "NONE" and m.resolve("alphabeta 1.0") == "Alphabeta-1.0"


def test_spark_nulls_repeats_empty_and_clashing_columns(spark):
    ref = spark.createDataFrame([*LIST, (None, "x"), LIST[0]], "license_ref string, full_name string")
    df = spark.createDataFrame([(1, "quartzite 1.1", "keep"), (2, None, None), (3, "nope", "k"), (1, "quartzite 1.1", "keep")], "id long, v string, license_ref string")
    out = cn.map_names(df, "v", ref)
    assert out.columns == ["id", "v", "license_ref_", "license_ref"]
    assert sorted((r.id, r.license_ref) for r in out.where("v is not null").collect()) == [(1, "Quartzite-1.1"), (1, "Quartzite-1.1"), (3, "NONE")]
    assert out.where("v is null").first().license_ref is None
    assert cn.map_names(df.limit(0), "v", ref).count() == 0
    assert {r.license_ref for r in cn.map_names(df, "v", ref.limit(0)).collect()} == {"NONE", None}
    with pytest.raises(ValueError):
        cn.reference_entries(ref, "license_ref", "full_name", max_entries=3)


@pytest.mark.parametrize("length", [1, 100, 5_000, 200_000])
def test_addresses_of_any_length(length):
    m = cn.NameMatcher(LIST, WORDS)
    path = "x/" * length
    assert m.resolve(f"https://licenses.example/{path}quartzite-1.1.html") == "Quartzite-1.1"
    assert m.resolve(f"licenses.example/{path}quartzite-1.1/") == "Quartzite-1.1"
    assert m.resolve("a." * length + "b") == "NONE"


def test_unmatched_values_come_with_the_entries_near_them(spark):
    ref = spark.createDataFrame(LIST, "license_ref string, full_name string")
    df = spark.createDataFrame([("Driftwater 9",), ("Driftwater 9",), ("nope",), (None,), ("quartzite 1.1",)], "v string")
    got = {r.value: (r.n_rows, [(x.ref, x.distance) for x in r.near]) for r in cn.unmatched(df, "v", ref).collect()}
    assert set(got) == {"Driftwater 9", "nope"} and got["nope"] == (1, [])
    assert got["Driftwater 9"] == (2, [("Driftwater-NC-3.0", 0), ("Driftwater-PL-2.0", 0), ("Driftwater-PL-2.0-or-later", 0)])
    left = cn.not_written_exactly(spark.createDataFrame([(1, LIST[0][0]), (2, LIST[0][1]), (3, LIST[0][0].lower())], "id long, v string"), "v", ref.union(ref.selectExpr("null", "null")))
    assert [r.id for r in left.collect()] == [3]
