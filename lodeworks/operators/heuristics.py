"""Heuristics over package metadata and releases, and the rules that combine them into a probability.

Each heuristic yields ``PASS``, ``FAIL`` or ``SKIP``.  Heuristics are columns or grouped aggregations; the only Python is
the keyboard-aware name similarity, which compares pre-filtered pairs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"


def _verdict(fail: Column, skip: Column | None = None) -> Column:
    v = F.when(fail, FAIL).otherwise(PASS)
    return F.when(skip, SKIP).otherwise(v) if skip is not None else v


def empty_project_link(links: Column) -> Column:
    return _verdict(F.coalesce(F.size(links), F.lit(0)) <= 0)


def source_code_repo(repo: Column) -> Column:
    return _verdict(repo.isNull())


def one_release(count: Column) -> Column:
    return _verdict(count == 1, count.isNull())


def release_gaps(releases: DataFrame, package: str = "package", seq: str = "seq", at: str = "upload_time") -> DataFrame:
    """``(package, n_releases, mean_gap)``: mean whole days between releases in document order, rounded down.

    The divisor counts all releases, the sum only those with a time on both sides.
    """
    w = Window.partitionBy(package).orderBy(seq)
    gap = F.expr(f"abs(timestampdiff(SECOND, _before, {at})) div 86400")
    g = releases.withColumn("_before", F.lag(at).over(w)).withColumn("_gap", gap)
    return g.groupBy(package).agg(F.count("*").alias("n_releases"), F.expr("CASE WHEN count(*) > 1 THEN sum(_gap) div (count(*) - 1) END").alias("mean_gap"))


def high_release_frequency(mean_gap: Column, threshold: int = 2) -> Column:
    return _verdict(mean_gap <= threshold, mean_gap.isNull())


def unchanged_release(releases: DataFrame, package: str = "package", digest: str = "digest") -> DataFrame:
    """``(package, result)``: FAIL if two releases have the same digest."""
    return releases.groupBy(package).agg(_verdict(F.count(digest) > F.count_distinct(digest), F.count(digest) == 0).alias("result"))


def closer_release_join_date(df: DataFrame, package: str, joined: str, released: str, days: int = 5) -> DataFrame:
    """``(package, result)``: PASS if any maintainer joined at least ``days`` before or after the release."""
    far = F.max(F.expr(f"abs(timestampdiff(SECOND, {joined}, {released})) >= {days * 86400}"))
    return df.groupBy(package).agg(F.when(F.count(released) == 0, SKIP).when(far, PASS).otherwise(FAIL).alias("result"))


def wheel_absence(wheels: Column) -> Column:
    return _verdict(F.coalesce(wheels, F.lit(0)) == 0)


def suspicious_setup(imports: Column, needles: Sequence[str] = ("base64", "request")) -> Column:
    """FAIL if an imported or required name contains a suspicious word."""
    return _verdict(F.exists(imports, lambda i: F.lit(False) if not needles else _any_contains(i, needles)), imports.isNull())


def _any_contains(c: Column, needles: Sequence[str]) -> Column:
    out = c.contains(needles[0])
    for n in needles[1:]:
        out = out | c.contains(n)
    return out


def python_imports(source: Column) -> Column:
    """Modules named by import statements of a source text (lexical)."""
    return F.regexp_extract_all(source, F.lit(r"(?m)^[ \t]*(?:import|from)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))


#: The eight ways of writing a date as one number, as orders of year, month and day with the width of the year.
_DATE_FORMS = (("Y", "M", "D", 4), ("Y", "D", "M", 4), ("D", "M", "Y", 4), ("M", "D", "Y", 4), ("Y", "M", "D", 2), ("Y", "D", "M", 2), ("D", "M", "Y", 2), ("M", "D", "Y", 2))


def anomalous_version(epoch: Column, major: Column, minor: Column, micro: Column, uploaded: Column, valid: Column, max_epoch: int = 3, max_major: int = 20, day_error: int = 4) -> Column:
    """Struct of the result and the kind of versioning told from the upload date."""
    y, m, d = F.year(uploaded), F.month(uploaded), F.day(uploaded)
    in_year = lambda v: (v == y) | (v == y % 100)
    in_month = lambda v: v == m
    in_days = lambda v: v.between(d - day_error, d + day_error)
    as_date = F.lit(False)
    text = major.cast("string")
    for a, b, c, width in _DATE_FORMS:
        n, at, parts = 4 + width, 1, {}
        for f in (a, b, c):
            w = width if f == "Y" else 2
            parts[f] = F.substring(F.lpad(text, n, "0"), at, w).try_cast("int")
            at += w
        # A number has lost the leading zero of its first field.
        as_date = as_date | (F.length(text).isin(n, n - 1) & in_year(parts["Y"]) & in_month(parts["M"]) & in_days(parts["D"]))
    year_first = in_year(major)
    calendar = (year_first & ((in_month(minor) & in_days(micro)) | (in_days(minor) & in_month(micro)))) | (~year_first & ((((in_month(major) & in_days(minor)) | (in_days(major) & in_month(minor))) & in_year(micro)) | as_date))
    kind = F.when(~valid, "invalid").when(calendar, "calendar").when(year_first, "calendar_semantic").otherwise("semantic")
    bad = (epoch > max_epoch) | ((kind == "calendar_semantic") & (minor > max_major)) | ((kind == "semantic") & (major > max_major))
    return F.struct(F.when(kind == "invalid", SKIP).when(bad, FAIL).otherwise(PASS).alias("result"), kind.alias("kind"))


#: Characters of an unquoted local part besides the dots between its atoms.
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: A mail address in running text: dotted atoms, then at least two host labels of which the last is letters only.
EMAIL = rf"{_ATOM}+(?:[.]{_ATOM}+)*@(?:{_LABEL}[.])+[A-Za-z]{{2,63}}(?:[^A-Za-z0-9-]|$)"
#: Words by which a description says that a package is a reservation (fixed values).
INTENT_WORDS = ("stub", "placeholder", "dependency confusion", "security", "namespace protection", "reserved", "prevent")


def fake_email(*texts: Column) -> Column:
    """SKIP without any text, PASS with a well-formed address in any, else FAIL."""
    both = F.concat_ws("\n", *texts)
    return F.when(F.coalesce(*texts).isNull() | (F.trim(both) == ""), SKIP).when(both.rlike(EMAIL), PASS).otherwise(FAIL)


def description_intent(*texts: Column) -> Column:
    return F.when(F.concat_ws(" ", *texts).rlike(rf"(?i)\b(?:{'|'.join(INTENT_WORDS)})\b"), PASS).otherwise(FAIL)


def stub_name(name: Column) -> Column:
    return F.when(F.lower(name).contains("stub"), PASS).otherwise(FAIL)


def type_stub_files(files: DataFrame, package: str, name: str, least: int = 10) -> DataFrame:
    """``(package, result)``: PASS with at least ``least`` stub files."""
    n = F.sum(F.col(name).endswith(".pyi").cast("int"))
    return files.groupBy(package).agg(F.when(n >= least, PASS).otherwise(FAIL).alias("result"))


def structure_hash(files: DataFrame, package: str, name: str) -> DataFrame:
    """``(package, hash)`` of the sorted set of file names without the package's own name."""
    return files.groupBy(package).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(name))), 256).alias("hash"))


def similar_projects(hashes: DataFrame, package: str, maintainer: str) -> DataFrame:
    """``(package, result)``: FAIL if another package of the same maintainer has the same structure; no pairs are built."""
    twins = hashes.groupBy(maintainer, "hash").agg(F.count_distinct(package).alias("n"))
    return hashes.join(twins, [maintainer, "hash"]).groupBy(package).agg(_verdict(F.max("n") > 1).alias("result"))


# ---------------------------------------------------------------------------------------------------------------------
# Name similarity

#: Rows of the keyboard (fixed values).
KEYBOARD = ("1234567890-", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}


def adjacent(a: str, b: str) -> bool:
    """Neighbours on the keyboard, in any direction."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1


def jaro(a: str, b: str, near: float = 0.8, cost: float = 1.0) -> float:
    """Jaro similarity in which matched letters out of order cost less if they are neighbours on the keyboard."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = list(range(len(b)))
    left, right = [], []
    for i, c in enumerate(a):
        hit = next((j for j in free if i - reach <= j <= i + reach and b[j] == c), None)
        if hit is not None:
            free.remove(hit)
            left.append(c)
            right.append(hit)
    if not left:
        return 0.0
    m = len(left)
    moved = sum(0.0 if c == b[j] else near if near and adjacent(c, b[j]) else cost for c, j in zip(left, sorted(right), strict=True)) / 2.0
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3.0


def name_ratio(a: str, b: str, scaling: float = 0.15) -> float:
    """Jaro with a bonus for up to four equal first letters."""
    j = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + same * scaling * (1 - j)


def letter_bits(name: str) -> int:
    """64 bits for the letters of a name with their repetitions; what two names share, their bits share."""
    out, seen = 0, {}
    for c in name:
        k = seen[c] = seen.get(c, -1) + 1
        n = ord(c) - 97
        out |= 1 << (n + 26 * k if 0 <= n < 26 and k < 2 else 52 + (ord(c) + 5 * k) % 12)
    return out


class NameIndex:
    """Names in their order, and for another name those whose ratio to it may reach the threshold: none that does is left out.

    Of a name's letters, at least as many stay unmatched as it has bits that the other lacks.  With m matches
    jaro <= (m/|a| + m/|b| + 1) / 3, and the ratio grows with jaro and with the number of equal first letters.
    """

    def __init__(self, names: Sequence[str], threshold: float, scaling: float = 0.15):
        self.names, self.threshold, self.scaling = names, threshold, scaling
        self.length = np.array([len(n) for n in names], np.int64)
        self.per = 1.0 / np.maximum(self.length, 1)
        self.bits = np.array([letter_bits(n) for n in names], np.uint64)
        self.head = np.array([[ord(c) for c in n[:4]] + [-1] * (4 - len(n[:4])) for n in names], np.int64).reshape(-1, 4)

    def near(self, x: str) -> list[int]:
        """Places in the order of the list."""
        if not x:
            return [i for i, n in enumerate(self.names) if not n]
        b = np.uint64(letter_bits(x))
        most = np.minimum(len(x) - np.bitwise_count(b & ~self.bits).astype(np.int64), self.length - np.bitwise_count(self.bits & ~b).astype(np.int64))
        bound = (most * (self.per + 1.0 / len(x)) + 1.0) / 3.0
        best = 4 * self.scaling
        at = np.flatnonzero(bound + best * (1.0 - bound) >= self.threshold - 1e-9)
        head = np.array([ord(c) for c in x[:4]] + [-2] * (4 - len(x[:4])), np.int64)
        same = np.logical_and.accumulate(self.head[at] == head, axis=1).sum(axis=1)
        bound = bound[at]
        return at[bound + same * self.scaling * (1.0 - bound) >= self.threshold - 1e-9].tolist()


def typosquatting(names: DataFrame, name: str, popular: Sequence[str], threshold: float = 0.95, most: int = 100_000) -> DataFrame:
    """``(name, result, popular, ratio)`` against a list in its order: an exact hit passes, the first similar one fails.

    The list ships to the workers, so its length is checked.  A name is compared with those of :class:`NameIndex`.
    """
    if len(popular) > most:
        raise ValueError(f"more than {most} popular names")
    popular = list(dict.fromkeys(popular))

    def look(index: NameIndex, x: str | None) -> tuple[str, str | None, float | None]:
        if not popular or x is None:
            return SKIP, None, None
        for i in index.near(x):
            p = popular[i]
            if p == x:
                return PASS, None, None
            r = name_ratio(x, p)
            if r >= threshold:
                return FAIL, p, r
        return PASS, None, None

    schema = T.StructType([T.StructField("result", T.StringType()), T.StructField("popular", T.StringType()), T.StructField("ratio", T.DoubleType())])

    @F.pandas_udf(schema)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = NameIndex(popular, threshold)
        for s in batches:
            yield pd.DataFrame([look(index, x) for x in s], columns=["result", "popular", "ratio"])

    return names.select(F.col(name), udf(F.col(name)).alias("r")).select(name, "r.result", "r.popular", "r.ratio")


# ---------------------------------------------------------------------------------------------------------------------
# Combination

#: Rule, weight, heuristics that must fail, heuristics that must pass (fixed values).
_QUICK, _FORCE = ("empty_project_link", "closer_release_join_date"), ("suspicious_setup", "wheel_absence")
RULES: tuple[tuple[str, float, tuple[str, ...], tuple[str, ...]], ...] = (
    ("high_1", 1.0, (*_QUICK, *_FORCE, "one_release"), ()),
    ("high_2", 1.0, (*_QUICK, *_FORCE, "high_release_frequency"), ()),
    ("high_3", 1.0, ("source_code_repo", "high_release_frequency", "closer_release_join_date", *_FORCE), ("unchanged_release",)),
    ("high_4", 1.0, (*_QUICK, *_FORCE, "typosquatting_presence"), ()),
    ("medium_1", 0.7, (*_QUICK, "high_release_frequency", "unchanged_release"), ("suspicious_setup",)),
    ("medium_2", 0.7, (*_QUICK, "one_release", "anomalous_version", "type_stub_file", "package_description_intent"), ()),
    ("medium_3", 0.7, (*_QUICK, "similar_projects", "one_release", "fake_email"), ()),
    ("medium_4", 0.7, (*_QUICK, "similar_projects", "high_release_frequency", "fake_email"), ()),
)
#: Not in the default set: its heuristic is no part of the default analysis.
HIGH_5 = ("high_5", 1.0, (*_FORCE, "stub_name", "anomalous_version"), ())
#: A heuristic runs only if those it depends on had one of these results (fixed values).
GATES: Mapping[str, Mapping[str, Sequence[str]]] = {
    "source_code_repo": {"empty_project_link": (PASS,)},
    "high_release_frequency": {"one_release": (PASS,)},
    "unchanged_release": {"high_release_frequency": (FAIL,)},
    "suspicious_setup": {"closer_release_join_date": (FAIL,)},
    "anomalous_version": {"one_release": (FAIL,)},
    "suspicious_patterns": {"source_code_repo": (FAIL, SKIP)},
}


def gate(results: DataFrame, gates: Mapping[str, Mapping[str, Sequence[str]]] = GATES) -> DataFrame:
    """Wide results in which a heuristic whose dependencies did not come out as asked is SKIP."""
    out = results
    for h, deps in gates.items():
        if h in out.columns and all(d in out.columns for d in deps):
            ok = F.lit(True)
            for d, accepted in deps.items():
                ok = ok & F.col(d).isin(*accepted)
            out = out.withColumn(h, F.when(ok, F.col(h)).otherwise(SKIP))
    return out


def widen(results: DataFrame, key: str, heuristics: Iterable[str]) -> DataFrame:
    """Long ``(key, heuristic, result)`` to one column per heuristic; absent ones are SKIP."""
    hs = list(heuristics)
    return results.groupBy(key).pivot("heuristic", hs).agg(F.first("result")).na.fill(SKIP, hs)


def rule_names(rules: Sequence[tuple] = RULES) -> list[str]:
    """All heuristics that some rule asks for."""
    return sorted({h for _, _, f, p in rules for h in (*f, *p)})


def rule_probability(wide: DataFrame, key: str, rules: Sequence[tuple] = RULES) -> DataFrame:
    """``(key, triggered, probability)``: the chance that at least one triggered rule is right."""
    hits, stay = [], F.lit(1.0)
    for name, weight, fails, passes in rules:
        on = F.lit(True)
        for h in fails:
            on = on & (F.col(h) == FAIL)
        for h in passes:
            on = on & (F.col(h) == PASS)
        hits.append(F.when(on, F.lit(name)))
        stay = stay * F.when(on, F.lit(1.0 - weight)).otherwise(F.lit(1.0))
    return wide.select(key, F.array_compact(F.array(*hits)).alias("triggered"), F.round(F.lit(1.0) - stay, 6).alias("probability"))


def noisy_or(df: DataFrame, key: str, p: str) -> DataFrame:
    """``(key, probability)`` of independent probabilities in rows."""
    return df.groupBy(key).agg(F.round(1 - F.product(1 - F.col(p)), 6).alias("probability"))
