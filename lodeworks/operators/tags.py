"""Which tag of a repository marks a version.

Pass one finds tags that are the version up to separators and a usual prefix, as an equi-join on a normalised key.  Pass
two scores the remaining tags of a repository in Arrow batches; only tags that hold the version's parts one behind the other
are scored, so candidates come from a join on repository and run of parts, never from all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_PARTS = re.compile(r"[0-9]+|[a-z]+")
#: Words before a version that say nothing (fixed values).
PREFIXES = ("v", "version", "ver", "release", "rel", "r", "tag")
#: Parts of a version that a tag must hold in a row to be scored.
RUN = 6
_SUFFIX = re.compile(r"(?:final|ga|release)$")


def parse_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, tag, commit)`` of a remote's listing, one ``hash<tab or space>refs/tags/name`` per line; the commit behind an annotated tag wins."""
    lines = df.select(key, F.explode(F.split(text, r"\r?\n")).alias("l")).where("trim(l) <> ''")
    p = lines.select(key, F.regexp_extract("l", r"^(\S+)[\t ]+(.+)$", 1).alias("commit"), F.regexp_extract("l", r"^(\S+)[\t ]+(?:refs/tags/)?(.+)$", 2).alias("ref")).where("ref <> ''")
    p = p.select(key, F.regexp_replace("ref", r"\^\{\}$", "").alias("tag"), "commit", F.col("ref").endswith("^{}").alias("peeled"))
    return p.groupBy(key, "tag").agg(F.max_by("commit", F.col("peeled").cast("int")).alias("commit"))


def tag_key(tag: Column) -> Column:
    """The version a tag spells: lower case, without path and usual prefix, one separator."""
    t = F.lower(F.element_at(F.split(tag, "/"), -1))
    t = F.regexp_replace(t, rf"^(?:{'|'.join(PREFIXES)})[-_.]?(?=[0-9])", "")
    return F.regexp_replace(F.regexp_replace(t, r"[^0-9a-z]+", "."), r"^\.|\.$", "")


def score(version: str, name: str, tag: str) -> float:
    """Likeness of a tag to a version from 0 to 1: all parts in order are needed; every further part of the tag that is no prefix word and no part of the name costs."""
    want, have = _PARTS.findall(version.lower()), _PARTS.findall(_SUFFIX.sub("", tag.lower()))
    known = set(_PARTS.findall(name.lower())) | set(PREFIXES)
    n, m = len(want), len(have)
    for at in range(m - n + 1):
        if have[at : at + n] == want:
            before, after = have[:at], have[at + n :]
            if before and before[-1].isdigit():
                continue  # 1.2.3 does not spell version 2.3
            cost = sum(0.05 if b in known else 0.2 for b in before) + sum(0.4 if a.isdigit() else 0.3 for a in after)
            return max(0.0, 1.0 - cost)
    return 0.0


def match_tags(versions: DataFrame, tags: DataFrame, least: float = 0.5) -> DataFrame:
    """``(repo, name, version, tag, score)``: the best tag of every version.

    ``versions(repo, name, version)``, ``tags(repo, tag)``.  Equal scores: the shorter, then the alphabetically first tag.
    """
    t = tags.select("repo", "tag", tag_key(F.col("tag")).alias("key")).distinct()
    v = versions.select("repo", "name", "version", tag_key(F.col("version")).alias("key")).distinct()
    exact = v.join(t, ["repo", "key"]).select("repo", "name", "version", "tag", F.lit(1.0).alias("score"))
    rest = v.join(exact.select("repo", "name", "version").distinct(), ["repo", "name", "version"], "left_anti")
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[a-z]+)"), F.lit(1))
    first = rest.withColumn("run", F.array_join(F.slice(split("version"), 1, RUN), ".")).where("run <> ''")
    own = t.select("repo", "tag", split("tag").alias("p")).where("size(p) > 0")
    # All runs of up to RUN parts of a tag, each once.
    ends = lambda p, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(p) - i)), lambda n: F.array_join(F.slice(p, i + 1, n), "."))
    parts = own.select("repo", "tag", F.explode(F.array_distinct(F.flatten(F.transform("p", lambda x, i: ends(F.col("p"), i))))).alias("run"))

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in batches:
            yield pd.Series([score(x, y or "", z) for x, y, z in zip(a, b, c, strict=True)], dtype="float64")

    close = first.join(parts, ["repo", "run"]).withColumn("score", scored("version", "name", "tag")).where(F.col("score") >= least)
    out = exact.unionByName(close.select("repo", "name", "version", "tag", "score"))
    w = Window.partitionBy("repo", "name", "version").orderBy(F.col("score").desc(), F.length("tag"), "tag")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def find_commit(purls: DataFrame, tags: DataFrame) -> DataFrame:
    """``(repo, version, commit, outcome)``: the version is a commit hash itself, a tag's name, a pseudo-version, or is matched to a tag."""
    from lodeworks.functions.urls import is_commit_hash
    from lodeworks.functions.versions import pseudo_version

    v = F.col("version")
    direct = purls.join(tags.select("repo", F.col("tag").alias("version"), F.col("commit").alias("_c")), ["repo", "version"], "left")
    best = match_tags(purls.select("repo", "name", "version"), tags).join(tags, ["repo", "tag"]).select("repo", "name", "version", F.col("commit").alias("_m"))
    j = direct.join(best, ["repo", "name", "version"], "left")
    commit = F.coalesce(F.when(is_commit_hash(v), v), "_c", pseudo_version(v)["commit"], "_m")
    outcome = F.when(is_commit_hash(v), "hash").when(F.col("_c").isNotNull(), "tag").when(pseudo_version(v).isNotNull(), "pseudo_version").when(F.col("_m").isNotNull(), "matched").otherwise("no_match")
    return j.select("repo", "name", "version", commit.alias("commit"), outcome.alias("outcome"))
