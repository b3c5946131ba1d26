"""Version order, ranges and normalisers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATTERN = r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?([0-9]*))?(?:(-[0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"

_NUMERIC = r"^[0-9]+(?:\.[0-9]+)*$"


def _g(v: Column, n: int) -> Column:
    return F.regexp_extract(v, _PATTERN, n)


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def _release(r: Column) -> Column:
    """Release numbers without trailing zeros, each raised by one: 0 ends the release, so that 1 comes before 1.1."""
    parts = F.filter(F.split(F.regexp_replace(r, r"(?:^|\.)0+(?:\.0+)*$", ""), r"\."), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")) + 1)


def version_key(v: Column) -> Column:
    """Sortable array of a PEP 440 version; null if it is none.

    Layout: epoch, release numbers without trailing zeros, a terminator, then ranks for pre, post and development
    releases.  Arrays compare element by element, so comparing keys is comparing versions.
    """
    pre, post, dev = F.lower(_g(v, 3)), (_g(v, 5) != "") | (_g(v, 6) != ""), _g(v, 8) != ""
    rank = F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3).when(dev & ~post, 0).otherwise(4).cast("bigint")
    post_n = F.when(post, _int(F.regexp_replace(F.concat(_g(v, 5), _g(v, 7)), "-", ""))).otherwise(-1).cast("bigint")
    dev_n = F.when(dev, _int(_g(v, 9))).otherwise(F.lit(2**62)).cast("bigint")
    full = F.concat(F.array(_int(_g(v, 1))), _release(_g(v, 2)), F.array(F.lit(0).cast("bigint"), rank, _int(_g(v, 4)), post_n, dev_n))
    plain = F.concat(F.array(F.lit(0).cast("bigint")), _release(v), F.array(*[F.lit(x).cast("bigint") for x in (0, 4, 0, -1, 2**62)]))
    return F.when(v.rlike(_NUMERIC), plain).when(v.rlike(_PATTERN), full)  # most versions are plain numbers and skip the grammar


def numeric_key(v: Column) -> Column:
    """Key of a purely numeric version, exact for ``1.2.3`` forms; null for anything else."""
    return F.when(v.rlike(_NUMERIC), version_key(v))


def last_events(events: Column) -> Column:
    """The last introduced and the last fixed version of a range's events, as a struct."""
    def last(field: str) -> Column:
        return F.try_element_at(F.filter(F.transform(events, lambda e: e[field]), lambda x: x.isNotNull()), F.lit(-1)).alias(field)

    return F.when(F.size(events) > 0, F.struct(last("introduced"), last("fixed")))


def in_range(version: Column, introduced: Column, fixed: Column) -> Column:
    """introduced <= version < fixed; a missing or unreadable lower bound is 0, a missing or unreadable upper bound none."""
    v, lo, hi = version_key(version), version_key(introduced), version_key(fixed)
    return v.isNotNull() & (lo.isNull() | (v >= lo)) & (hi.isNull() | (v < hi))


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """``(package, version, adv)`` of versions inside any range of an advisory for their package and ecosystem.

    ``packages(package, ecosystem, version)``, ``advisories(adv, affected)``.  An equi-join on the name, then the range;
    keys are built once a row before the join, not once a pair.
    """
    flat = (
        advisories.select("adv", F.explode("affected").alias("a"))
        .where("a.package.name is not null")
        .select("adv", F.col("a.package.name").alias("package"), F.col("a.package.ecosystem").alias("ecosystem"), F.explode("a.ranges").alias("r"))
        .where("size(r.events) > 0")
        .select("adv", "package", "ecosystem", last_events(F.col("r.events")).alias("e"))
        .select("adv", "package", "ecosystem", version_key(F.col("e.introduced")).alias("lo"), version_key(F.col("e.fixed")).alias("hi"))
    )
    keyed = packages.select("package", "ecosystem", "version", version_key(F.col("version")).alias("v")).where("v is not null")
    return keyed.join(flat, ["package", "ecosystem"]).where("(lo is null or v >= lo) and (hi is null or v < hi)").select("package", "version", "adv").distinct()


def highest_tag(df: DataFrame, key: str, tag: str) -> DataFrame:
    """The tag with the highest readable version of each key; versions must be above 0."""
    k = version_key(F.col(tag))
    return df.withColumn("_k", k).where(F.col("_k").isNotNull() & (F.col("_k") > version_key(F.lit("0")))).groupBy(key).agg(F.max_by(tag, "_k").alias(tag))


def jdk_version(v: Column) -> Column:
    """Major version of a Java release from 5 to 24: ``1.8.0_292`` is 8; null beyond."""
    major = F.regexp_extract(v, r"^\s*(?:1\.)?([0-9]+)", 1).try_cast("int")
    return F.when((major >= 5) & (major <= 24), major.cast("string"))


def pseudo_version(v: Column) -> Column:
    """Parts of a module pseudo-version: base, time and commit, or null."""
    p = r"^(v[0-9]+\.[0-9]+\.[0-9]+)-([0-9]{14})-([0-9a-f]+)$"
    return F.when(v.rlike(p), F.struct(F.regexp_extract(v, p, 1).alias("base"), F.try_to_timestamp(F.regexp_extract(v, p, 2), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("time"), F.regexp_extract(v, p, 3).alias("commit")))


def version_parts(v: Column) -> Column:
    """Runs of letters and digits of a version."""
    return F.regexp_extract_all(F.lower(v), F.lit("([0-9a-z]+)"), F.lit(1))
