"""Registered queries over small tables of their own: nothing is left out by key, by form of name or by number."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks import pipeline_queries  # noqa: F401 - registers its queries
from lodeworks.fact_queries import QUERIES
from lodeworks.operators import dataflow, heuristics, resolution, tags, timestamps
from lodeworks.operators.graph import NoFixpoint


def parts(spark, folder, keys):
    spark.createDataFrame([(k, f"n {k}", "STEEL", k % 50 + 1) for k in keys], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_dataflow_fixpoint_takes_all_components(spark, tmp_path):
    ids = [*range(1, 12), *range(395, 406), *range(20_000, 20_011)]
    edges = {(p, p + s) for p in ids for s in {0: (1, 2), 1: (1,), 2: (1,)}.get(p % 5, ()) if p + s in ids}
    want = {(n, "a", f"lit{n}") for n in ids if n % 5 == 0}
    while True:
        moved = {(d, loc, v) for n, loc, v in want for s, d in edges if s == n}
        more = {(n, "b", "x" + v) for n, loc, v in want | moved if loc == "a" and n % 5 == 1} | moved
        if more <= want:
            break
        want |= more
    got = [tuple(r) for r in QUERIES["dataflow_fixpoint"](spark, parts(spark, tmp_path, ids)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(n for n, _, _ in want) > 20_000


def test_nearest_ancestor_takes_all_parts(spark, tmp_path):
    ids, want = [*range(1, 40), *range(2_990, 3_010), *range(1_495, 1_505), 747, 748, 749, 750, 751, 752, 373, 374, 375, 376, 186, 187, 188, 93, 94, 46, 47], set()
    for k in ids:
        at = k
        while at in ids and at % 7:
            at //= 2
        if at in ids:
            want.add((k, at))
    got = [tuple(r) for r in QUERIES["nearest_ancestor"](spark, parts(spark, tmp_path, ids)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(n for n, _ in want) >= 3_000


def bom(spark, folder, names=(), groups=()):
    rows = [(i, n, g) for i, (n, g) in enumerate([*((n, None) for n in names), *(("c", g) for g in groups)])]
    spark.createDataFrame(rows, "row_id long, comp_name string, group_name string").write.parquet(f"{folder}/bom_components.parquet")
    return str(folder)


def test_typosquatting_compares_whole_names_with_all_popular_ones(spark, tmp_path):
    # More than 200 popular names stand before those that are squatted.
    names = [f"a{i:03}-filler" for i in range(220) for _ in range(10)] + ["Kogumr-tagger-http"] * 9 + [" kogumr-tagger-http\t", "zuvone.pruner.sql", *["zuvone.pruner.sql"] * 9]
    names += ["kogumr-tagger-htpp", "kogumr-mixer-xml", "'zuvone.pruner.sq", "7zip-tagger", "(kinubr.pruner", " ", None]
    got = {r.name: (r.result, r.popular) for r in QUERIES["typosquat_candidates"](spark, bom(spark, tmp_path, names)).collect() if "filler" not in r.name}
    assert got == {
        "kogumr-tagger-http": ("PASS", None), "zuvone.pruner.sql": ("PASS", None), "kogumr-tagger-htpp": ("FAIL", "kogumr-tagger-http"), "kogumr-mixer-xml": ("PASS", None),
        "'zuvone.pruner.sq": ("FAIL", "zuvone.pruner.sql"), "7zip-tagger": ("PASS", None), "(kinubr.pruner": ("PASS", None),
    }


def test_name_index_leaves_out_no_pair():
    r = random.Random(1)
    names = ["".join(r.choice("abé-1") for _ in range(r.randint(0, 14))) for _ in range(150)] + ["".join(r.sample("requests-numpy", 14)) for _ in range(100)]
    changed = []
    for n in names:
        w = list(n)
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at : at + r.randint(0, 2)] = r.choice(["", "a", "-", "é"])
        changed.append("".join(w))
    pairs = 0
    for t in (0.95, 0.8):
        index = heuristics.NameIndex(names, t)
        for x in changed:
            want = {i for i, p in enumerate(names) if heuristics.name_ratio(x, p) >= t}
            pairs += len(want)
            assert want <= set(index.near(x))
    assert pairs > 300


def test_same_org_gives_every_group_an_organisation(spark, tmp_path):
    want = {
        "org.apache.commons": "org.apache", "Io-Leduft.Table": "io-leduft.table", "com-suzuda.proto": "com-suzuda.proto", "@gididr": "@gididr", " @mapava\r\n": "@mapava",
        "\nOrg.Quillforge\u00a0": "org.quillforge", "com . furevl": "com.furevl", "org..suzars": "org.suzars", '"DEV.PUMOZL.KIT"': "dev.pumozl", "<org . quillforge)": "org.quillforge",
        "forge.example/nebovu": "forge.example/nebovu", " com.GitHub.me.lib": "com.github.me", "solo": "solo", "": "", "\t": "",
    }
    rows = QUERIES["same_org"](spark, bom(spark, tmp_path, groups=[*want, *want, None])).collect()
    assert len(rows) == len(want) and {r.group_name: r.organisation for r in rows} == want


def test_suspicious_patterns_runs_every_default_rule(spark, tmp_path):
    bad = ["x\nexec(b64decode(s))", r"'\x41\x42\x43\x44\x45\x46\x47\x48'", "''.join(map(chr, a))", "__import__( name)", "requests.post(u, data=os.environ)", "if 'QEMU' in x:", "sys.gettrace()"]
    good = ["exec(x)\nb64decode(y)", "__import__( 'os')", "os.environ", "", "join(a)"]
    rows = [*enumerate([*bad, *good]), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.result for r in QUERIES["suspicious_patterns"](spark, str(tmp_path)).collect()}
    assert got == {i: "FAIL" if i < len(bad) else "PASS" for i in range(len(bad) + len(good))}


def test_times_of_any_length():
    t = "2024-03-01T10:00:00"
    texts = [t + "Z", " " * 90 + t + "Z" + "\t" * 90, t + ".123456" + "7" * 200 + "Z", "1709287200." + "1" * 100, "01.02." + "2" * 100, "9" * 200, "x1" * 5_000]
    us, ok = timestamps.instants(texts, [None] * 7, [None] * 7)
    assert ok.tolist() == [True] * 4 + [False] * 3
    assert us[:4].tolist() == [1_709_287_200_000_000] * 2 + [1_709_287_200_123_456, 1_709_287_200_111_111]


def test_ancestors_of_any_depth_and_cycles(spark):
    n = 3000
    rows = [(i, i - 1 if i else None, "job" if i == 0 else "step") for i in range(n)] + [(-1, None, "step"), (-2, -1, "step")]
    df = spark.createDataFrame(rows, "node long, parent long, kind string")
    assert {tuple(r) for r in resolution.nearest_ancestor(df, "job").collect()} == {(i, 0) for i in range(n)}
    loop = spark.createDataFrame([(1, 2, "step"), (2, 1, "step")], "node long, parent long, kind string")
    with pytest.raises(NoFixpoint):
        resolution.nearest_ancestor(loop, "job", max_rounds=6)


def test_values_that_are_too_long_are_marked(spark):
    effects = spark.createDataFrame([(1, "a", "x" * 9000, None, None), (1, "b", "y" * 2000, "a", None), (1, "c", "z", "b", None)], "node long, location string, prefix string, source string, suffix string")
    got = {(r.location, r.value) for r in dataflow.fixpoint(effects, spark.createDataFrame([], "src long, dst long")).collect()}
    assert got == {("a", "x" * 9000), ("b", dataflow.TOO_LONG), ("c", dataflow.TOO_LONG)}
    scripts = spark.createDataFrame([(1, "echo 'source f.sh' > f.sh\nsource f.sh"), (2, "A=1\necho $A")], "id long, s string")
    kinds = {(r.id, r.kind) for r in dataflow.interpret_scripts(scripts, "id", "s").collect()}
    assert (1, "incomplete") in kinds and (2, "incomplete") not in kinds


def test_tags_against_all_pairs(spark):
    r = random.Random(9)
    word = lambda: r.choice(["v", "release", "lib", "rc", "final", "x"])
    number = lambda: ".".join(str(r.randint(0, 3)) for _ in range(r.randint(1, 4)))
    versions = sorted({(repo, "lib", number() + r.choice(["", "", "rc1"])) for repo in ("a", "b") for _ in range(40)})
    listed = sorted({(repo, r.choice(["", word() + "-", word() + "/"]) + number().replace(".", r.choice(".-_")) + r.choice(["", "-" + word(), ".0", "rc1"])) for repo in ("a", "b") for _ in range(60)})
    out = tags.match_tags(spark.createDataFrame(versions, "repo string, name string, version string"), spark.createDataFrame(listed, "repo string, tag string")).collect()
    got = {(m.repo, m.version): (m.tag, round(m.score, 6)) for m in out}
    key = lambda t: spark.createDataFrame([(x,) for x in t], "t string").select(tags.tag_key(F.col("t"))).collect()
    tag_keys = dict(zip([t for _, t in listed], [k[0] for k in key([t for _, t in listed])], strict=True))
    version_keys = dict(zip([v for _, _, v in versions], [k[0] for k in key([v for _, _, v in versions])], strict=True))
    want = {}
    for repo, name, v in versions:
        exact = [t for x, t in listed if x == repo and tag_keys[t] == version_keys[v]]
        scored = [(-1.0, len(t), t) for t in exact] or [(-s, len(t), t) for x, t in listed if x == repo and (s := tags.score(v, name, t)) >= 0.5]
        if scored:
            want[repo, v] = (min(scored)[2], round(-min(scored)[0], 6))
    assert got == want and len(want) > 10
