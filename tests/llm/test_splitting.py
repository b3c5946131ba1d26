"""Problem 8 against a plain tokenizer and by cases."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from lodeworks.llm import splitting as sp
from lodeworks.llm.tokens import token_count

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")
SCHEMA = "doc_id long, text string, cut string, p string"


def count(t):
    return len(TOKEN.findall(t or ""))


def kind(t, limit):
    if count(t) <= limit:
        return None
    return "forced" if max(count(s) for s in regex.split(r"\n|(?<=[.!?])\s", t)) > limit else "natural"


def text(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["word", "a_b", "x-y", "ünï", "数字", "3.14", "(", "--"]))
        out.append(rng.choices([" ", ". ", "\n", "! ", "\n\n", ".\n", "\r\n", " ", "\t", ".", ""], [60, 8, 2, 1, 1, 1, 1, 1, 1, 1, 3])[0])
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    t = [text(rng, rng.randint(0, 400)) for _ in range(150)]
    return [*t, None, "", "   \n", "w " * 500, "word" * 50_000, "one. " * 300, "." * 1000, "a\n" * 400, " lead " + "w " * 90 + "\n\n  "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], SCHEMA)


def test_token_count(spark, texts):
    got = {r.doc_id: r.n for r in frame(spark, texts).select("doc_id", token_count(F.col("text")).alias("n")).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [30, 64])
def test_cut_kind(spark, texts, limit):
    out = sp.cut_kind(frame(spark, texts), limit=limit)
    assert out.columns == ["doc_id", "text", "cut_", "p", "cut"]
    assert {r.doc_id: r.cut for r in out.collect()} == {i: k for i, t in enumerate(texts) if (k := kind(t, limit))}


@pytest.mark.parametrize(("limit", "overlap"), [(30, 8), (64, 16), (40, 0), (20, 19)])
def test_pieces(spark, texts, limit, overlap):
    rows = sp.split_oversized(frame(spark, texts), limit=limit, overlap=overlap).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if count(t) > limit}
    for i, ps in by.items():
        t = texts[i]
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(ps[0].n_pieces))
        at, before = 0, None
        for p in ps:
            assert p.tokens == count(p.piece_text) <= limit
            assert t[p.start : p.start + len(p.piece_text)] == p.piece_text
            assert p.start + p.overlap_chars == at
            if before is not None:
                last = TOKEN.findall(before)[-overlap:] if overlap else []
                assert TOKEN.findall(p.piece_text[: p.overlap_chars]) == last
            core = p.piece_text[p.overlap_chars :]
            at += len(core)
            before = p.piece_text
            end = t[at:]
            natural = not end.strip() or regex.match(r"[^\S\n]*\n", end) or (t[at - 1] in ".!?" and end[0].isspace())
            assert p.forced or natural, (i, p.piece, t[at - 10 : at + 10])
            if p.forced:  # no boundary could have been reached
                assert count(core) == limit - (overlap if p.piece else 0) or natural
        assert not t[at:].strip()


def test_empty_repeated_and_bad_overlap(spark):
    df = frame(spark, ["w " * 60, "w " * 60])
    assert sp.split_oversized(df.limit(0)).count() == 0 and sp.cut_kind(df.limit(0)).count() == 0
    one = df.where("doc_id = 0")
    assert sp.split_oversized(one.union(one), limit=50, overlap=5).count() == 4
    with pytest.raises(ValueError):
        sp.split_oversized(df, limit=10, overlap=10)


def test_very_long_text(spark):
    df = frame(spark, ["Some words stand here. " * 60_000])
    rows = sp.split_oversized(df).agg(F.max("tokens").alias("m"), F.count("*").alias("n"), F.max("forced").alias("f")).first()
    assert rows.m <= 512 and rows.n > 600 and rows.f is False


@pytest.mark.parametrize("limit", [512, 2048, 8192, 32768])
def test_limits_do_not_grow_the_stack(spark, limit):
    n = 3 * limit
    df = frame(spark, ["w " * n, "One two three. " * (n // 4), "a b c\n\n" * (n // 3), "x " * (limit // 2) + "\n" + "y " * n])
    overlap = limit // 8
    rows = sp.split_oversized(df, limit=limit, overlap=overlap).collect()
    for i in range(4):
        ps = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert all(p.tokens <= limit for p in ps) and sum(p.tokens for p in ps) == count(df.where(f"doc_id = {i}").first().text) + overlap * (len(ps) - 1)
        assert any(p.forced for p in ps) == (i in (0, 3))
    assert {r.doc_id: r.cut for r in sp.cut_kind(df, limit=limit, overlap=overlap).collect()} == {0: "forced", 1: "natural", 2: "natural", 3: "forced"}


def test_a_stretch_that_only_the_overlap_leaves_no_room_for(spark):
    df = frame(spark, ["a " * 60 + "\n" + "b " * 58 + "\n" + "c " * 30])
    assert [r.cut for r in sp.cut_kind(df, limit=64, overlap=16).collect()] == ["natural"]
    assert any(r.forced for r in sp.split_oversized(df, limit=64, overlap=16).collect())


def test_many_pieces_and_short_ones(spark):
    df = frame(spark, ["a.\n\n" * 4000])
    rows = sorted(sp.split_oversized(df, limit=10, overlap=9).collect(), key=lambda r: r.piece)
    assert len(rows) > sp.GROUP and all(count(r.piece_text) == r.tokens <= 10 for r in rows)
    assert all(count(r.piece_text[: r.overlap_chars]) == 9 for r in rows[1:])
