"""Problem 7: find every document that carries passages of held-out evaluation items, and the items it leaks.

Method: one Aho-Corasick automaton over the normalised items reads every document once.  Its alphabet is words: each word of
the items is one character, so a document becomes a string with a character a word.  Its patterns are all pairs of
neighbouring words of the items' own texts; a hit says where in the document and where in the item the same words stand.
Word numbers are mapped back to offsets in the original.

* The normalised text is the sequence of words (unbroken runs of letters and digits) in one letter case, so layout, case
  and punctuation do not count.
* An exact check follows on the few (document, item) pairs with enough hits: runs of common words are grown into
  stretches that may hold single changed, missing or added words; stretches of at least a sentence are chained in the
  order of the item; the pair is a leak if the chain covers at least half of the item's words.
* Before the check, two pairs that stand next to each other, or around one changed, missing or added word, are a seed at
  their place in the item (:data:`SEEDS`).  The seeds asked for are so few that a document with half of an item's words,
  every third of them changed, has them whichever half it is (:func:`seeds_needed`).  Seeds that stand in many items are
  boilerplate and not counted, unless an item would have too few left: then all its seeds count.  What is boilerplate is
  decided over all items.  The exact check counts all words.
* A standing instruction, which opens several items of a suite before a blank line, is no part of an item's own text.

The items are few and their size is checked; a set too large for one automaton is searched in blocks with the same rows.
Documents are read where they lie: no shuffle, no pairs of documents, whole texts.

Defined results: null, empty and blank documents leak nothing; items without words of their own are never leaked; equal
documents and equal items each get their own rows; a (document, item) pair is reported once, with its best chain.  Passages
in which no two neighbouring words are left are not found.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")

#: Words between the starts of two pairs in the document and in the item: side by side, around a changed word, a missing one,
#: an added one.
SEEDS = ((1, 1), (3, 3), (2, 3), (3, 2))
#: Words of the longest seed.
SPAN = 5
#: A seed that stands in more items than this is boilerplate.
MAX_ITEMS = 2
#: Largest gap inside a stretch, in words of the item and of the document.
GAP = 3
#: Words that may be missing at either end of the sentence which a stretch must hold.
EDGE = 2
#: Of the seeds that an unchanged half has, one in so many is asked for.  A change in every third word leaves one in three,
#: and half of the words are then left only of three quarters of an item.
LEFT = 3
#: Seeds below which an item's boilerplate counts, too.
FEW = 3
#: Bytes of item text, and different words, of one automaton.
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 1_000_000
#: Characters of document text scanned at a time.
SCAN_CHARS = 4 << 20


class Item(NamedTuple):
    """An item's own words, and its sentences as (first word, last word)."""

    item_id: int
    words: tuple[str, ...]
    sentences: tuple[tuple[int, int], ...]


class Chain(NamedTuple):
    """A leak: item words covered, words in the item, and the stretches as (document word from, to, item word from, to)."""

    covered: int
    of: int
    stretches: tuple[tuple[int, int, int, int], ...]


def normal_words(text: str) -> list[str]:
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [w.lower() for w in _WORD.findall(text)]  # some letters grow when lowered and would break their word


def own_texts(rows: list[tuple[int, str | None, str | None]]) -> list[Item]:
    """Items ``(id, suite, text)`` without the standing instruction of their suite."""
    heads = Counter()
    for _, suite, text in rows:
        if text and (m := _BLANK_LINE.search(text)):
            heads[suite, text[: m.start()].strip()] += 1
    out = []
    for item_id, suite, text in rows:
        text = text or ""
        m = _BLANK_LINE.search(text)
        if m and heads[suite, text[: m.start()].strip()] > 1 and text[m.end() :].strip():
            text = text[m.end() :]
        if words := normal_words(text):
            sentences, at = [], 0
            for part in _SENTENCE_END.split(text):
                if n := len(normal_words(part)):
                    sentences.append((at, at + n - 1))
                    at += n
            out.append(Item(item_id, tuple(words), tuple(sentences)))
    return out


def pairs_of(it: Item) -> list[tuple[str, ...]]:
    """Neighbouring words of an item, by position; the word itself if there is only one."""
    return [it.words] if len(it.words) == 1 else list(zip(it.words, it.words[1:], strict=False))


def seeds_of(it: Item) -> Iterator[tuple[int, int, tuple]]:
    """``(position, words between the pairs in the document, seed)``; items too short for seeds have their pairs as such."""
    pairs = pairs_of(it)
    if len(it.words) < 2 * SPAN:
        yield from ((i, 0, (0, p, p)) for i, p in enumerate(pairs))
        return
    for in_doc, in_item in SEEDS:
        for i in range(len(pairs) - in_item):
            yield i, in_doc, (in_doc, pairs[i], pairs[i + in_item])


def boilerplate(items: Iterable[Item]) -> frozenset[tuple]:
    """Seeds that stand in more than ``MAX_ITEMS`` items."""
    spread: Counter = Counter()
    for it in items:
        spread.update({s for _, _, s in seeds_of(it)})
    return frozenset(p for p, n in spread.items() if n > MAX_ITEMS)


def seeds_needed(it: Item, counted: list[bool], share: float) -> int:
    """Counted places of seeds that any ``share`` of an item's words holds at least, in one stretch or in whole sentences; over ``LEFT``."""
    m, half = len(it.words), -int(-share * len(it.words) // 1)
    sums = np.concatenate([[0], np.cumsum(counted)])
    inside = max(half - SPAN + 1, 0)
    ends = np.arange(inside, m + 1)
    lone = int((sums[ends] - sums[ends - inside]).min())
    of = lambda a, b: float(sums[max(b - SPAN + 2, a)] - sums[a])
    parts, left, least = sorted((of(a, b) / (b - a + 1), b - a + 1) for a, b in it.sentences), half, 0.0
    for density, n in parts:
        least += density * min(n, left)
        left -= min(n, left)
    return int(min(lone, least)) // LEFT


def _letter(k: int) -> str:
    """The character of word number ``k``; surrogates are left out."""
    c = 0x100 + k
    return chr(c if c < 0xD800 else c + 0x800)


class Searcher:
    """The automaton over a block of items, and the exact check."""

    def __init__(self, items: list[Item], share: float = 0.5, common: frozenset[tuple] | None = None):
        self.items, self.share = items, share
        common = boilerplate(items) if common is None else common
        self.letters: dict[str, str] = {}
        for it in items:
            for w in it.words:
                if w not in self.letters:
                    self.letters[w] = _letter(len(self.letters))
        number: dict[tuple[str, ...], int] = {}
        pairs = [np.array([number.setdefault(p, len(number)) for p in pairs_of(it)], np.int64) for it in items]
        self.sorted = [(np.sort(k), np.argsort(k, kind="stable")) for k in pairs]
        self.n_pairs = len(number)
        #: First place of each item; a place is a word of an item.
        self.starts = np.cumsum([0, *(len(it.words) for it in items)])
        self.needed = np.zeros(len(items), np.int64)
        tables: dict[int, list[tuple[int, int]]] = {}
        for n, it in enumerate(items):
            seeds = list(seeds_of(it))
            flags = [True] * len(it.words)
            for i, _, s in seeds:
                flags[i] &= s not in common
            if need := max(0, seeds_needed(it, flags, share)) if len(it.words) >= 2 * SPAN else 0:
                seeds = [x for x in seeds if x[2] not in common] if need >= FEW else seeds
            if need < FEW:
                need = max(1, seeds_needed(it, [True] * len(it.words), share))
            self.needed[n] = need
            for i, gap, (_, p, q) in seeds:
                tables.setdefault(gap, []).append((number[p] * self.n_pairs + number[q], int(self.starts[n]) + i))
        #: By words between the pairs: seeds, and the places at which each stands.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for gap, rows in tables.items():
            t = np.array(sorted(set(rows)), np.int64)
            keys, first = np.unique(t[:, 0], return_index=True)
            self.tables[gap] = (keys, np.append(first, len(t)), t[:, 1])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in number.items():
            self.automaton.add_word("".join(self.letters[w] for w in p), k)
        self.automaton.make_automaton()

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the documents in one string, places of all hits in it (that of the last word) and their pairs, in order."""
        get = self.letters.get
        coded = ["".join([get(w, " ") for w in normal_words(t)]) for t in texts]
        starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
        # Neither a blank nor a line feed is a letter, so no hit crosses an unknown word or the end of a document.
        found = chain.from_iterable(self.automaton.iter("\n".join(coded))) if len(self.automaton) else ()
        h = np.fromiter(found, np.int64).reshape(-1, 2)
        return starts, h[:, 0], h[:, 1]

    def candidates(self, starts: np.ndarray, last: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) with enough of the item's places hit."""
        if not len(last):
            return
        # A place holds one pair, or also a word that is an item by itself; those have a table of their own.
        at = np.full(int(starts[-1]) + SPAN, -1, np.int64)
        at[last] = pair
        found: list[np.ndarray] = []
        total = int(self.starts[-1])
        for gap, (keys, first, places) in self.tables.items():
            if gap:
                p, q = pair, at[last + gap]
                near = q >= 0
                seed, j = p[near] * self.n_pairs + q[near], last[near]
            else:
                seed, j = pair * self.n_pairs + pair, last
            k = np.searchsorted(keys, seed)
            same = keys[np.minimum(k, len(keys) - 1)] == seed
            k, j = k[same], j[same]
            n = first[k + 1] - first[k]
            at_place = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.repeat(np.searchsorted(starts, j, side="right") - 1, n) * total + places[at_place])
        once = np.unique(np.concatenate(found))
        d, item = once // total, np.searchsorted(self.starts, once % total, side="right") - 1
        key, count = np.unique(d * len(self.items) + item, return_counts=True)
        for x in key[count >= self.needed[key % len(self.items)]].tolist():
            yield divmod(x, len(self.items))

    def runs(self, last: np.ndarray, pair: np.ndarray, n: int) -> list[list[int]]:
        """Maximal runs of words that stand in a document and in item ``n`` alike: ``[document from, item from, words]``.

        ``last`` and ``pair`` are the hits in the document.
        """
        ids, place = self.sorted[n]
        lo, hi = np.searchsorted(ids, pair), np.searchsorted(ids, pair, side="right")
        out: list[list[int]] = []
        open_runs: dict[int, list[int]] = {}
        size = 1 if len(self.items[n].words) == 1 else 2
        at = np.flatnonzero(hi > lo)
        for j, a, b in zip((last[at] - size + 1).tolist(), lo[at].tolist(), hi[at].tolist(), strict=True):
            for i in place[a:b].tolist():
                r = open_runs.get(j - i)
                if size == 2 and r and r[0] + r[2] - 1 == j:
                    r[2] += 1
                else:
                    r = open_runs[j - i] = [j, i, size]
                    out.append(r)
        out.sort()
        return out

    def chain(self, runs: list[list[int]], n: int) -> Chain | None:
        """The best chain of stretches of item ``n`` made of runs, or None if it covers less than the share."""
        it = self.items[n]
        m = len(it.words)
        if sum(w for _, _, w in runs) < 0.5 * self.share * m:  # half of a stretch's words must stand in runs
            return None
        # Runs are joined into stretches over gaps of a few words.
        best: list[tuple[int, int]] = []  # (matched words, index of the run before or -1)
        recent: list[int] = []
        for k, (j, i, w) in enumerate(runs):
            top, prev = w, -1
            keep = []
            for q in recent:
                qj, qi, qw = runs[q]
                if qj + qw + GAP < j:
                    continue
                keep.append(q)
                dj, di = j - (qj + qw), i - (qi + qw)
                over = max(0, -dj, -di)
                if over < w and max(dj, di) <= GAP and min(dj, di) >= -1 and i > qi and j > qj and best[q][0] + w - over > top:
                    top, prev = best[q][0] + w - over, q
            best.append((top, prev))
            recent = [*keep, k]
        tails = set(range(len(runs))) - {p for _, p in best if p >= 0}
        first = list(range(len(runs)))
        for k, (_, p) in enumerate(best):
            if p >= 0:
                first[k] = first[p]
        stretches = []
        for k in tails:
            dj0, di0 = runs[first[k]][0], runs[first[k]][1]
            dj1, di1 = runs[k][0] + runs[k][2] - 1, runs[k][1] + runs[k][2] - 1
            if di1 - di0 + 1 < min(m, 2 * EDGE) or best[k][0] < 0.5 * (di1 - di0 + 1):
                continue
            # A stretch that covers the share alone need not hold a sentence.
            if di1 - di0 + 1 >= self.share * m or any(di0 <= a + EDGE and di1 >= b - EDGE for a, b in it.sentences):
                stretches.append((dj0, dj1, di0, di1))
        return self._ordered(stretches, m) if sum(d - c + 1 for _, _, c, d in stretches) >= self.share * m else None

    def _ordered(self, stretches: list[tuple[int, int, int, int]], m: int) -> Chain | None:
        """The chain that covers most words of an item of ``m``: stretches follow each other in the document and in the item.

        ``top[e]`` is the best chain so far whose last item word is ``e``; a stretch sees the chains that end before it in the
        document and gains its words behind theirs.
        """
        top, score, before = np.zeros(m, np.int64), [], []
        chain_at = np.full(m, -1, np.int64)
        order = sorted(range(len(stretches)), key=lambda k: stretches[k][0])
        done = sorted(range(len(stretches)), key=lambda k: stretches[k][1])
        score, before, settled = [0] * len(stretches), [-1] * len(stretches), 0
        words = np.arange(m)
        for k in order:
            a, _, c, d = stretches[k]
            while settled < len(done) and stretches[done[settled]][1] < a:
                q = done[settled]
                e = stretches[q][3]
                if score[q] > top[e]:
                    top[e], chain_at[e] = score[q], q
                settled += 1
            gain = top[:d] + d - np.maximum(words[:d], c - 1)
            e = int(gain.argmax()) if d else -1
            if e >= 0 and top[e] > 0 and gain[e] > d - c + 1:
                score[k], before[k] = int(gain[e]), int(chain_at[e])
            else:
                score[k] = d - c + 1
        k = max(range(len(stretches)), key=lambda x: score[x])
        covered, path = score[k], []
        while k >= 0:
            path.append(stretches[k])
            k = before[k]
        return Chain(covered, m, tuple(reversed(path))) if covered >= self.share * m else None

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, Chain]]:
        """(number of the text, item, chain) of all leaks."""
        starts, last, pair = self.hits(texts)
        for d, n in self.candidates(starts, last, pair):
            lo, hi = np.searchsorted(last, starts[d : d + 2])
            if (runs := self.runs(last[lo:hi] - starts[d], pair[lo:hi], n)) and (c := self.chain(runs, n)):
                yield d, self.items[n].item_id, c

    def leaks(self, text: str | None) -> Iterator[tuple[int, Chain]]:
        """Leaked items of a document."""
        for _, item, c in self.search([text] if text else []):
            yield item, c


def original_span(text: str, first: int, last: int) -> tuple[int, int]:
    """Offsets in the original text of the words numbered ``first`` to ``last``."""
    start = end = 0
    for k, m in enumerate(_WORD.finditer(text)):
        if k == first:
            start = m.start()
        if k == last:
            end = m.end()
            break
    return start, end


_SEARCHERS: dict[str, Searcher] = {}


def _searcher(key: str, items: tuple[Item, ...], share: float, common: frozenset[tuple]) -> Searcher:
    """One automaton per worker process and block."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(list(items), share, common)
    return _SEARCHERS[key]


def blocks(items: list[Item], size: int = BLOCK_BYTES, words: int = BLOCK_WORDS) -> list[tuple[Item, ...]]:
    """Items in blocks of at most ``size`` bytes of text and ``words`` different words."""
    out: list[list[Item]] = []
    total, seen = 0, set()
    for it in items:
        n = sum(map(len, it.words)) + len(it.words)
        if not out or total + n > size or len(seen | set(it.words)) > words:
            out.append([])
            total, seen = 0, set()
        out[-1].append(it)
        total += n
        seen.update(it.words)
    return [tuple(b) for b in out]


NAMES = ("id", "item_id", "covered", "item_words", "start", "end", "stretches")


def find_leaks(docs: DataFrame, evals: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", suite_col: str = "suite", item_text: str = "text", share: float = 0.5, max_item_bytes: int = 256 << 20) -> DataFrame:
    """``(id, item_id, covered, item_words, start, end, stretches)``: one row per document and leaked item.

    ``start`` and ``end`` are offsets in the original text of the first and last word of the chain.
    """
    narrow = evals.select(F.col(item_col).cast("long").alias("i"), F.col(suite_col).cast("string").alias("s"), F.col(item_text).cast("string").alias("t"))
    size = narrow.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    if size > max_item_bytes:
        raise ValueError(f"the items hold {size} bytes; they are searched from memory up to {max_item_bytes}")
    items = own_texts([(r.i, r.s, r.t) for r in narrow.orderBy("i").collect()])
    common = boilerplate(items)
    schema = "id long, item_id long, covered int, item_words int, start int, end int, stretches int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    types = [pa.int64()] * 2 + [pa.int32()] * 5

    def searched(block: tuple[Item, ...]):
        key, mine = uuid.uuid4().hex, frozenset(s for it in block for _, _, s in seeds_of(it) if s in common)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _searcher(key, block, share, mine)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                out: list[list] = [[] for _ in NAMES]
                at = 0
                while at < len(texts):
                    to, chars = at, 0
                    while to < len(texts) and (to == at or chars + len(texts[to]) <= SCAN_CHARS):
                        chars += len(texts[to])
                        to += 1
                    for d, item_id, c in s.search(texts[at:to]):
                        start, end = original_span(texts[at + d], c.stretches[0][0], c.stretches[-1][1])
                        for col, v in zip(out, (ids[at + d], item_id, c.covered, c.of, start, end, len(c.stretches)), strict=True):
                            col.append(v)
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=list(NAMES))

        return run

    found = [rows.mapInArrow(searched(b), schema) for b in blocks(items)]
    if not found:
        return rows.limit(0).mapInArrow(lambda it: iter(()), schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
