"""Problem 6: the subset-sum programme against brute force, and the packing's invariants."""

import itertools
import random
from collections import Counter

from lodeworks.llm import packing as pk

SCHEMA = "doc_id long, text string, id string, bucket string, len string"


def test_fullest_is_the_best_multiset():
    rng = random.Random(1)
    for _ in range(150):
        counts = {rng.randint(1, 25): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        target = rng.randint(0, 60)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= target)
        got = pk.fullest(counts, target)
        assert sum(k * m for k, m in got.items()) == best
        assert all(m <= counts[k] for k, m in got.items())


def test_fills_place_every_item_once():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 100) for _ in range(5000))
    fills = pk.minimum_bin_slack(counts, 100)
    placed = Counter()
    for f in fills:
        assert sum(k * m for k, m in f.lengths.items()) <= 100
        for k, m in f.lengths.items():
            placed[k] += m * f.repeat
    assert placed == counts
    assert sum(f.repeat for f in fills) <= 1.02 * sum(k * n for k, n in counts.items()) / 100


def test_work_does_not_grow_with_the_number_of_items():
    fills = pk.minimum_bin_slack({7: 10**12, 30: 10**12 + 1, 64: 3 * 10**11}, 100)
    assert len(fills) < 20 and sum(f.repeat * f.lengths.get(7, 0) for f in fills) == 10**12


def pack(spark, texts, capacity=10):
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in texts], SCHEMA)
    return [r.asDict() for r in pk.pack(df, capacity=capacity).collect()]


def test_packing_invariants(spark):
    rng = random.Random(4)
    lengths = {i: rng.choice([0, 1, 2, 3, 5, 7, 10, 11, 20, 37]) for i in range(600)}
    rows = pack(spark, [(i, "w " * n) for i, n in lengths.items()])
    total, load, divided = Counter(), Counter(), Counter()
    for r in rows:
        total[r["id"]] += r["tokens"]
        load[r["container_id"]] += r["tokens"]
        divided[r["id"]] += 1
        assert r["tokens"] <= 10
    assert dict(total) | {i: 0 for i, n in lengths.items() if not n} == lengths
    assert max(load.values()) <= 10
    assert all((divided[i] > 1) == (n > 10) and divided[i] == max(1, -(-n // 10)) for i, n in lengths.items())
    used = sum(1 for v in load.values() if v)
    assert used <= -(-sum(lengths.values()) // 10) + 2


def test_nulls_empty_repeats_and_long(spark):
    rows = pack(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "c"), (5, "x " * 50_003), (6, "y " * 20), (6, "z " * 20)])
    assert sum(r["tokens"] for r in rows) == 4 + 1 + 50_003 + 40
    load = Counter()
    for r in rows:
        load[r["container_id"]] += r["tokens"]
    assert max(load.values()) <= 10 and len([r for r in rows if r["id"] == 5]) == 5001
    assert {r["id"] for r in rows if r["n_pieces"] > 1} == {5, 6}
    assert pack(spark, []) == []
    assert len(pack(spark, [(1, None), (2, None)])) == 2


def test_a_shared_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(pk, "BUCKET_ROWS", 50)
    rows = pack(spark, [(i, "w w w") for i in range(1000)])
    load = Counter(r["container_id"] for r in rows)
    assert len(rows) == 1000 and max(load.values()) == 3 and len(load) == 334


def test_divided_items_and_fill(spark):
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([10, 11, 20, 25, 3, 7, 0])], "doc_id long, text string")
    packed = pk.pack(df, capacity=10)
    assert sorted(r.id for r in pk.divided(packed).collect()) == [1, 2, 3]
    f = pk.fill(packed, 10).first()
    assert f.containers >= f.least == 8 and f.fullest == 10 and f.share == round(76 / (f.containers * 10), 6)
    plan = pk.divided(packed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "container(" in plan  # the rows come from placed pieces
