"""Problem 7 by cases and against a plain search."""

import random

import pytest

from lodeworks.llm import leaks as lk

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "su", "ta", "vi", "zo") for b in ("bar", "den", "fil", "gon", "hus", "lak", "mer", "nod", "pil", "rus", "ster", "tov")]
HEAD = "Read the passage below with care and answer in one word what follows from it, weighing each statement."


def item(rng, n=8):
    return " ".join(" ".join(rng.choice(VOCAB) for _ in range(12)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    texts = [item(rng) for _ in range(12)]
    rows = [(i, "s", f"{HEAD}\n\n{t}" if i % 2 else t) for i, t in enumerate(texts)]
    return rng, texts, rows


def found(rows, text):
    s = lk.Searcher(lk.own_texts(rows))
    return sorted(i for i, _ in s.leaks(text))


def filler(rng, n=20):
    return " ".join(item(rng, 1) for _ in range(n))


def sentences(t):
    return [s.strip() + "." for s in t.split(".") if s.strip()]


def test_whole_layout_and_case(data):
    rng, texts, rows = data
    noisy = texts[3].upper().replace(" ", "  \n- ").replace(".", " !!")
    assert found(rows, filler(rng) + "\n" + noisy + "\n" + filler(rng)) == [3]


def test_half_counts_and_less_does_not(data):
    rng, texts, rows = data
    s = sentences(texts[5])
    assert found(rows, filler(rng) + " ".join(s[2:6]) + " " + filler(rng)) == [5]
    assert found(rows, filler(rng) + " ".join(s[2:5]) + " " + filler(rng)) == []


def test_several_stretches_in_order_only(data):
    rng, texts, rows = data
    s = sentences(texts[4])
    gap = lambda: " " + filler(rng, 3) + " "
    assert found(rows, gap().join(s[:6])) == [4]
    assert found(rows, gap().join(reversed(s))) == []


def test_changed_missing_and_added_words(data):
    rng, texts, rows = data
    out = []
    for k, w in enumerate(texts[7].split()):
        if k % 9 == 4:
            out.append("changed")
        elif k % 9 == 8:
            continue
        elif k % 13 == 6:
            out += [w, "added"]
        else:
            out.append(w)
    assert found(rows, filler(rng) + " " + " ".join(out)) == [7]


def test_standing_instruction_and_shuffled_words(data):
    rng, texts, rows = data
    assert found(rows, HEAD + "\n\n" + filler(rng)) == []
    w = texts[1].split()
    rng.shuffle(w)
    assert found(rows, " ".join(w)) == []


def test_against_a_plain_search(data):
    rng, texts, rows = data
    for _ in range(40):
        parts, want = [filler(rng, 2)], set()
        for i in rng.sample(range(12), 3):
            s = sentences(texts[i])
            n = rng.choice([1, 2, 3, 5, 6, 8])
            at = rng.randint(0, 8 - n)
            parts += [" ".join(s[at : at + n]), filler(rng, 2)]
            if n >= 4:
                want.add(i)
        assert set(found(rows, " ".join(parts))) == want


def test_blocks_cover_all_items(data):
    _, _, rows = data
    items = lk.own_texts(rows)
    for size in (1, 500, 2000, 10**9):
        assert [x for b in lk.blocks(items, size) for x in b] == items
    assert lk.blocks([]) == []


def edited(rng, words, every, kind):
    """The words with every ``every``-th changed, left out or doubled by another."""
    out = []
    for k, w in enumerate(words):
        hit = k % every == every - 1
        how = rng.choice(("changed", "missing", "added")) if kind == "mixed" else kind
        if not hit:
            out.append(w)
        elif how == "changed":
            out.append("zzz")
        elif how == "added":
            out += [w, "zzz"]
    return out


@pytest.mark.parametrize("every", [3, 4, 5])
@pytest.mark.parametrize("kind", ["changed", "missing", "added", "mixed"])
def test_recall_of_edited_passages(data, every, kind):
    """Whole items, and passages with half of the words left, with every third to fifth word edited: recall at least 0.9."""
    rng = random.Random(every)
    texts = [item(rng) for _ in range(60)]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    s = lk.Searcher(lk.own_texts(rows))
    whole, part = 0, 0
    for i, t in enumerate(texts):
        words = t.replace(".", "").split()
        n = len(words) if kind == "added" else int(len(words) * 0.5 * every / (every - 1)) + 2
        n = int(len(words) * 0.55) if kind == "added" else min(n + 4, len(words))
        at = rng.randint(0, len(words) - n)
        whole += i in {x for x, _ in s.leaks(filler(rng, 5) + " " + " ".join(edited(rng, words, every, kind)) + " " + filler(rng, 5))}
        part += i in {x for x, _ in s.leaks(filler(rng, 5) + " " + " ".join(edited(rng, words[at : at + n], every, kind)) + " " + filler(rng, 5))}
    assert whole >= 0.9 * len(texts) and part >= 0.9 * len(texts)


def test_items_of_shared_words(data):
    """Items with one opening, and items made of shared sentences only, are found by what they hold, each by its own share."""
    rng = random.Random(5)
    opening = item(rng, 4)
    texts = [opening + " " + item(rng, 3) for _ in range(6)]
    pool = [item(rng, 1) for _ in range(12)]
    mixed = [" ".join(rng.sample(pool, 8)) for _ in range(8)]
    rows = [(i, "s", t) for i, t in enumerate([*texts, *mixed])]
    for i, t in enumerate([*texts, *mixed]):
        assert i in found(rows, filler(rng) + " " + t + " " + filler(rng))
    # The opening is more than half of each of the six.
    assert [i for i in found(rows, filler(rng) + opening) if i < 6] == list(range(6))
    # One sentence of it is not.
    assert found(rows, filler(rng) + sentences(opening)[0]) == []
    items = lk.own_texts(rows)
    docs = [*texts, *mixed, opening, filler(rng) + opening]
    common = lk.boilerplate(items)
    one = {(d, i) for d, i, _ in lk.Searcher(items, common=common).search(docs)}
    each = {(d, i) for b in lk.blocks(items, 1) for d, i, _ in lk.Searcher(list(b), common=common).search(docs)}
    assert one == each


def test_short_items_and_many_repeats(data):
    rows = [(0, "s", "Alpha."), (1, "s", "Beta gamma."), (2, "s", "One two three four five six."), (3, "s", "la la la la la la la la la la la la.")]
    assert found(rows, "say alpha now") == [0] and found(rows, "beta, GAMMA") == [1] and found(rows, "gamma beta") == []
    assert found(rows, "zero one two three four") == [2]
    assert found(rows, "la " * 3000) == [3]
    long = item(random.Random(3))
    assert found([(0, "s", long)], (long + " ") * 300) == [0]


def test_spark(spark, data):
    rng, texts, rows = data
    ev = spark.createDataFrame([*rows, (90, "s", None), (91, None, ""), (92, "s", " \n\n "), (93, "s", texts[2])], "item_id long, suite string, text string")
    text = "İİ Intro -- " + texts[2] + " tail"
    long = filler(rng, 3000) + texts[0]
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, filler(rng), "x"), (1, text, "x"), (6, long, "x"), (None, texts[9], "x")], "doc_id long, text string, id string")
    out = lk.find_leaks(docs, ev).collect()
    assert sorted((r.id or -1, r.item_id) for r in out) == [(-1, 9), (1, 2), (1, 2), (1, 93), (1, 93), (6, 0)]
    r = next(r for r in out if r.id == 1)
    assert text[r.start : r.end] == texts[2][:-1] and r.covered == r.item_words
    assert lk.find_leaks(docs.limit(0), ev).count() == 0
    assert lk.find_leaks(docs, ev.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lk.find_leaks(docs, ev, max_item_bytes=10)


def test_blocks_give_the_same_rows(spark, data, monkeypatch):
    _, texts, rows = data
    ev = spark.createDataFrame(rows, "item_id long, suite string, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {(r.id, r.item_id) for r in lk.find_leaks(docs, ev).collect()}
    monkeypatch.setattr(lk, "blocks", lambda items, size=0: [tuple(items[:5]), tuple(items[5:])])
    assert {(r.id, r.item_id) for r in lk.find_leaks(docs, ev).collect()} == one == {(i, i) for i in range(12)}


def test_a_lone_stretch_needs_no_sentence():
    words = [f"w{i:02}" for i in range(40)]
    s = lk.Searcher(lk.own_texts([(1, "s", " ".join(words))]))
    assert [i for i, _ in s.leaks("before " + " ".join(words[8:32]) + " after")] == [1]
    assert [i for i, _ in s.leaks("before " + " ".join(words[8:24]) + " after")] == []
