"""Problem 1: map free-entered names to the closest entry of a reference list.

Method: the reference entries and their alias writings are paths of one character trie.  A query is searched with a
Levenshtein automaton (adjacent transpositions count one edit) that walks the trie and drops every branch which can no
longer end within the distance allowed for the query's length; all entries inside that distance are returned.

A writing carries three kinds of information and only the first is allowed to be misspelt:

* words (``quartzite community license``), searched in the trie; a table of word aliases says which words are other writings
  of one (``lic``, ``licence``) and which say nothing (an empty alias);
* the version number, compared exactly after ``2`` became ``2.0``;
* the variant (``or later``, noncommercial), compared exactly.

The trie is built once per Python worker from the reference list, which is small and whose size is checked before it is
shipped.  Rows are mapped where they are read, with a bounded dictionary of the values already seen: no shuffle, so a
value that fills a third of the table costs one search per worker and no skew.

Defined results
---------------
* null value: null (nothing was entered, nothing to map);
* empty, blank or punctuation-only value: ``NONE``;
* value of any length: searched whole; words beyond the longest alias simply exceed the distance;
* several entries at the same distance: resolved by version and variant; if more than one entry still fits, ``NONE``
  (ambiguous), never an arbitrary pick;
* an empty reference list: every non-null value is ``NONE``;
* an address of any length stands for the name at the end of its path;
* repeated rows: each keeps its own result row; extra columns pass through untouched, one that has the name of the result
  column with a trailing underscore.
"""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "NONE"

_HOST = re.compile(r"[\w.-]+\.[a-z]{2,}", re.I)
_SCHEME = re.compile(r"https?://", re.I)
_EXTENSION = re.compile(r"\.(?:html?|txt|md)$", re.I)
_LATER = re.compile(r"(?:\bor|(?<=\d)or|-or)[\s_-]*(?:any[\s_-]*)?later(?:[\s_-]*version)?\b|(?<=\d)\s*\)?\s*\+")
_NONCOM = re.compile(r"\bnon[\s_-]*commercial\b")
_PAREN_REF = re.compile(r"\(([^()]*)\)\W*$")
_VERSION = re.compile(r"(?<!\d)(?<!\d\.)(\d+(?:\.\d+)*)")
_WORD = re.compile(r"[a-z]+")


class Parsed:
    """What a writing says: its words, version and variant."""

    __slots__ = ("words", "versions", "later", "noncommercial")

    def __init__(self, words: tuple[str, ...], versions: frozenset[str], later: bool, noncommercial: bool):
        self.words, self.versions, self.later, self.noncommercial = words, versions, later, noncommercial


def fold(text: str) -> str:
    """Lower case without accents; compatibility forms are replaced."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def whole_version(v: str) -> str:
    """``2`` is ``2.0``; leading zeros do not count."""
    parts = [p.lstrip("0") or "0" for p in v.split(".")]
    return ".".join(parts if len(parts) > 1 else [*parts, "0"])


def last_of_address(s: str) -> str:
    """The name at the end of a web address without its file extension; any other text as it is."""
    bare = s.strip(" \t\r\n\xa0;.,*/")
    bare = bare[m.end() :] if (m := _SCHEME.match(bare)) else bare
    host, slash, path = bare.partition("/")
    name = path.rsplit("/", 1)[-1]
    if not slash or not name or "\n" in path or any(c.isspace() for c in name) or not _HOST.fullmatch(host):
        return s
    return _EXTENSION.sub("", name) or name


def parse(value: str, aliases: Mapping[str, str] = {}) -> Parsed:  # noqa: B006 - never written to
    """Split a writing into words, version and variant; ``aliases`` are other writings of words, empty for words that say nothing."""
    s = last_of_address(fold(value))
    later = bool(_LATER.search(s))
    s = _LATER.sub(" ", s)
    noncommercial = bool(_NONCOM.search(s))
    s = _NONCOM.sub(" ", s)
    versions = frozenset(whole_version(v) for v in _VERSION.findall(s))
    words = []
    for w in _WORD.findall(s):
        w = aliases.get(w, w)
        if w == "nc":
            noncommercial = True
        elif w == "orlater":
            later = True
        elif w:
            words.append(w)
    return Parsed(tuple(words), versions, later, noncommercial)


def allowed_distance(length: int) -> int:
    """Edits allowed for a query of this many characters."""
    return 0 if length < 4 else 1 if length < 6 else 2


class Trie:
    """Character trie; a node is ``[children, entries]``."""

    def __init__(self) -> None:
        self.root: list = [{}, ()]
        self.longest = 0

    def add(self, path: str, entry: int) -> None:
        node = self.root
        self.longest = max(self.longest, len(path))
        for c in path:
            node = node[0].setdefault(c, [{}, ()])
        if entry not in node[1]:
            node[1] = (*node[1], entry)

    def search(self, query: str, limit: int) -> dict[int, int]:
        """All entries within ``limit`` edits of ``query``, with their distance."""
        found: dict[int, int] = {}
        if len(query) > self.longest + limit:
            return found
        automaton = LevenshteinAutomaton(query, limit)
        stack = [(self.root, automaton.start(), None, "")]
        while stack:
            node, state, before, last = stack.pop()
            if node[1] and (d := automaton.distance(state)) is not None:
                for e in node[1]:
                    if d < found.get(e, limit + 1):
                        found[e] = d
            for c, child in node[0].items():
                after = automaton.step(state, before, last, c)
                if after:
                    stack.append((child, after, state, c))
        return found


class LevenshteinAutomaton:
    """States are sparse ``{position in the query: edits}``; an empty state accepts nothing any more."""

    def __init__(self, query: str, limit: int):
        self.query, self.limit = query, limit

    def start(self) -> dict[int, int]:
        return {i: i for i in range(min(self.limit, len(self.query)) + 1)}

    def step(self, state: dict[int, int], before: dict[int, int] | None, last: str, c: str) -> dict[int, int]:
        q, k, n, out = self.query, self.limit, len(self.query), {}

        def put(i: int, d: int) -> None:
            if d <= k and d < out.get(i, k + 1):
                out[i] = d

        for i, d in state.items():
            put(i, d + 1)  # a letter of the entry is missing in the query
            if i < n:
                put(i + 1, d + (q[i] != c))
        if before:  # two neighbouring letters changed places
            for i, d in before.items():
                if i + 1 < n and q[i] == c and q[i + 1] == last:
                    put(i + 2, d + 1)
        for i in sorted(out):  # a letter of the query is not in the entry
            d, j = out[i], i + 1
            while j <= n and d + 1 <= k and d + 1 < out.get(j, k + 1):
                d += 1
                out[j] = d
                j += 1
        return out

    def distance(self, state: dict[int, int]) -> int | None:
        return state.get(len(self.query))


class NameMatcher:
    """Maps writings to entries of a reference list of ``(ref, full_name)`` pairs."""

    def __init__(self, entries: Iterable[tuple[str, str | None]], aliases: Iterable[tuple[str, str]] = (), cache: int = 200_000):
        self.aliases = dict(aliases)
        self.refs: list[str] = []
        self.parsed: list[list[Parsed]] = []
        self.trie = Trie()
        self.kinds: set[str] = set()
        self.cache: OrderedDict[str, str] = OrderedDict()
        self.cache_size = cache
        self.near: dict[str, dict[int, int]] = {}
        rows = sorted({(r, f or "") for r, f in entries if r})
        for ref, full in rows:
            forms = [self.parse(ref), *([self.parse(full)] if full else [])]
            self.refs.append(ref)
            self.parsed.append(forms)
        heads = [forms[0].words[:1] for forms in self.parsed]
        self.heads = {h[0] for h in heads if h}
        for forms in self.parsed:
            for p in forms:
                self.kinds.update(w for w in p.words if w not in self.heads)
        for i, forms in enumerate(self.parsed):
            for path in self._aliases(forms):
                self.trie.add(path, i)

    def parse(self, value: str) -> Parsed:
        return parse(value, self.aliases)

    def _aliases(self, forms: list[Parsed]) -> set[str]:
        """Paths under which an entry may be written: its words joined, any order of head and kind, the head alone."""
        out = set()
        for p in forms:
            if not p.words:
                continue
            head, rest = p.words[0], p.words[1:]
            code = "nc" if p.noncommercial else ""
            out |= {"".join((head, *rest)), "".join((*rest, head)), head}
            if code:
                out |= {"".join((head, code, *rest)), head + code}
            if p.later:
                out |= {x + "orlater" for x in list(out)}
        return out

    def search(self, value: str) -> dict[str, int]:
        """All entries whose alias paths lie within the distance allowed for the writing, before version and variant."""
        return {self.refs[i]: d for i, d in self._search(self.parse(value)).items()}

    def _near(self, q: str) -> dict[int, int]:
        """Trie search with a bounded memory: many writings share a word."""
        if q not in self.near:
            if len(self.near) > self.cache_size:
                self.near.clear()
            self.near[q] = self.trie.search(q, allowed_distance(len(q)))
        return self.near[q]

    def _search(self, p: Parsed) -> dict[int, int]:
        found: dict[int, int] = {}
        for queries in ({w for w in p.words if w not in self.kinds}, {"".join(p.words)}):
            for q in queries - {""}:
                for i, d in self._near(q).items():
                    if d < found.get(i, 99):
                        found[i] = d
            if found:
                break
        return found

    def resolve(self, value: str) -> str:
        """The entry meant, or ``NONE``."""
        if value in self.cache:
            self.cache.move_to_end(value)
            return self.cache[value]
        out = self._resolve(value)
        self.cache[value] = out
        if len(self.cache) > self.cache_size:
            self.cache.popitem(last=False)
        return out

    def _resolve(self, value: str) -> str:
        p = self.parse(value)
        found = self._search(p)
        if not found:
            return NONE
        best = min(found.values())
        near = [i for i, d in found.items() if d == best]
        heads = {self.parsed[i][0].words[0] for i in near}
        if len(heads) > 1:
            return NONE
        fits = [i for i in found if self.parsed[i][0].words[0] in heads and self._fits(i, p)]
        if len(fits) > 1:  # the kind written decides between variants that differ in it
            kinds = set(p.words) & self.kinds
            fits = [i for i in fits if any(kinds <= set(f.words) for f in self.parsed[i])] or fits
        return self.refs[fits[0]] if len(fits) == 1 else NONE

    def _fits(self, i: int, p: Parsed) -> bool:
        form = self.parsed[i][0]
        joined = "".join(p.words)
        later = p.later or joined.endswith("orlater")
        noncommercial = p.noncommercial or any(w.endswith("nc") and w not in self.heads and self.trie.search(w[:-2], 0) for w in p.words)
        return form.versions == p.versions and form.later == later and form.noncommercial == noncommercial


_MATCHERS: dict[tuple, NameMatcher] = {}


def _matcher(entries: tuple[tuple[str, str], ...], aliases: tuple[tuple[str, str], ...]) -> NameMatcher:
    """One matcher per worker process and list."""
    key = (entries, aliases)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = NameMatcher(entries, aliases)
    return _MATCHERS[key]


def reference_entries(df: DataFrame, a: str, b: str, max_entries: int = 100_000) -> tuple[tuple[str, str], ...]:
    """Two columns of a small table on the driver; refused above ``max_entries`` rows, the proven bound of what is shipped."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null").distinct().limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"the list has more than {max_entries} entries")
    return tuple(sorted((r.a, r.b or "") for r in rows))


MATCH = T.StructType([T.StructField("ref", T.StringType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("distance", T.IntegerType())])))])


def match(value: Column, reference: DataFrame, ref: str, full_name: str, aliases: DataFrame | None = None, near: bool = False, max_entries: int = 100_000) -> Column:
    """Struct of ``ref``, the entry meant (or ``NONE``, or null for null), and ``near``: all entries within the distance, nearest first."""
    entries = reference_entries(reference, ref, full_name, max_entries)
    words = reference_entries(aliases, *aliases.columns[:2], max_entries) if aliases is not None else ()

    @F.pandas_udf(MATCH)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = _matcher(entries, words)
        for s in batches:
            refs = [None if v is None else m.resolve(v) for v in s]
            close = [None if v is None or not near else [{"ref": r, "distance": d} for r, d in sorted(m.search(v).items(), key=lambda x: (x[1], x[0]))] for v in s]
            yield pd.DataFrame({"ref": pd.Series(refs, dtype=object), "near": pd.Series(close, dtype=object)})

    return matched(value)


def map_names(df: DataFrame, value: str, reference: DataFrame, ref: str = "license_ref", full_name: str = "full_name", out: str = "license_ref", aliases: DataFrame | None = None) -> DataFrame:
    """``df`` with the column ``out``: the entry that ``value`` means, ``NONE``, or null for a null value.

    ``aliases`` has two columns: a word, and the word it stands for (empty for words that say nothing).
    """
    return df.select(*[F.col(c).alias(f"{c}_" if c == out else c) for c in df.columns], match(F.col(value), reference, ref, full_name, aliases)["ref"].alias(out))


def unmatched(df: DataFrame, value: str, reference: DataFrame, ref: str = "license_ref", full_name: str = "full_name", aliases: DataFrame | None = None) -> DataFrame:
    """``(value, n_rows, near)``: the values that mean no entry, each searched once, with all entries within their distance."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n_rows"))
    found = counts.withColumn("m", match(F.col("value"), reference, ref, full_name, aliases, near=True))
    return found.where(F.col("m.ref") == NONE).select("value", "n_rows", F.col("m.near").alias("near"))


def not_written_exactly(df: DataFrame, value: str, reference: DataFrame, ref: str = "license_ref", full_name: str = "full_name") -> DataFrame:
    """Rows whose value is not, character by character, a reference or a full name: an equi-join, whatever the list's length."""
    listed = reference.select(F.explode(F.array(ref, full_name)).alias(value)).where(F.col(value).isNotNull()).distinct()
    return df.join(listed, value, "left_anti")
