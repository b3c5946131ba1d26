"""Documents of package registries and hosting services as columns: one JSON text per row in, rows out.

Network sources are landing tables of such texts.  A text that is no JSON, or lacks the part asked for, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doc(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.try_parse_json(text).alias("_v")).where("_v is not null")


def _get(path: str, kind: str, v: str = "_v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def pypi_releases(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, version, filename, packagetype, upload_time, sha256)`` of the ``releases`` of a package document."""
    r = _doc(df, key, text).select(key, F.explode(_get("$.releases", "map<string,array<variant>>")).alias("version", "files"))
    f = r.select(key, "version", F.explode("files").alias("_f"))
    return f.select(key, "version", *[_get(p, "string", "_f").alias(n) for n, p in (("filename", "$.filename"), ("packagetype", "$.packagetype"), ("upload_time", "$.upload_time"), ("sha256", "$.digests.sha256"))])


def npm_latest(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, latest, tarball)``: the version tagged latest and its archive."""
    d = _doc(df, key, text).select(key, _get("$['dist-tags'].latest", "string").alias("latest"), _get("$.versions", "map<string,variant>").alias("_m")).where("latest is not null")
    return d.select(key, "latest", F.try_variant_get(F.element_at("_m", F.col("latest")), "$.dist.tarball", "string").alias("tarball"))


def maven_timestamps(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, version, published)`` of a search answer, whose timestamps are milliseconds."""
    d = _doc(df, key, text).select(key, F.explode(_get("$.response.docs", "array<variant>")).alias("_d"))
    return d.select(key, _get("$.v", "string", "_d").alias("version"), F.timestamp_millis(_get("$.timestamp", "bigint", "_d")).cast("timestamp_ntz").alias("published"))


def latest_release(timestamps: DataFrame, key: str) -> DataFrame:
    """``(key, version, published)``: the latest of :func:`maven_timestamps`."""
    return timestamps.groupBy(key).agg(F.max_by("version", F.struct("published", "version")).alias("version"), F.max("published").alias("published"))


def folder_assets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, is_folder, version, sha256)`` of a folder listing: folders are versions, files carry checksums."""
    d = _doc(df, key, text).select(key, F.explode(_get("$.children", "array<variant>")).alias("_c"))
    uri, folder = _get("$.uri", "string", "_c"), F.coalesce(_get("$.folder", "boolean", "_c"), F.lit(False))
    return d.select(key, uri.alias("path"), folder.alias("is_folder"), F.when(folder, F.ltrim(uri, F.lit("/"))).alias("version"), _get("$.checksums.sha256", "string", "_c").alias("sha256"))


def package_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, label, url)`` of an index document's links."""
    d = _doc(df, key, text).select(key, F.explode(_get("$.version.links", "array<struct<label:string,url:string>>")).alias("l"))
    return d.select(key, "l.label", "l.url")


def vulnerability_batch(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, id)`` of a batch answer: the ids found for query number ``n``."""
    d = _doc(df, key, text).select(key, F.posexplode(_get("$.results", "array<variant>")).alias("n", "_r"))
    return d.select(key, "n", F.explode(_get("$.vulns", "array<struct<id:string>>", "_r")).alias("v")).select(key, "n", "v.id")


def workflow_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, run_id, workflow_id, head_sha, event, created_at)`` of a page of runs."""
    d = _doc(df, key, text).select(key, F.explode(_get("$.workflow_runs", "array<variant>")).alias("_r"))
    fields = (("run_id", "$.id", "bigint"), ("workflow_id", "$.workflow_id", "bigint"), ("head_sha", "$.head_sha", "string"), ("event", "$.event", "string"), ("created_at", "$.created_at", "string"))
    return d.select(key, *[_get(p, k, "_r").alias(n) for n, p, k in fields])
