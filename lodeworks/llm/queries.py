"""Queries of the problems 1, 3, 6, 7 and 8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import canonical_names, format_duplicates, leaks, packing, splitting

CAPACITY, LIMIT, OVERLAP = 2048, 512, 64
COMPONENT = ["group_name", "comp_name", "purl"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "bom_licenses").select("lic_row_id", F.coalesce("license_id", "license_name").alias("value")).where("value is not null")


#: Other writings of words of licence names; an empty one says nothing about which licence is meant.
LICENSE_WORDS = {
    "licence": "license", "licens": "license", "lic": "license", "licenses": "license", "pub": "public", "perm": "permissive",
    "comm": "community", "doc": "documentation", "docs": "documentation", "lib": "library", "src": "source",
}
NO_LICENSE_WORDS = "a an the see under license licence licens lic licenses licensed approved released version ver v txt md html htm".split()


def _license_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*((w, m) for w, m in LICENSE_WORDS.items() if w not in NO_LICENSE_WORDS), *((w, "") for w in NO_LICENSE_WORDS)], "word string, means string")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that are no entry as they stand, with the entry meant or NONE."""
    listed = _t(spark, d, "license_list")
    rows = canonical_names.not_written_exactly(_filled(spark, d), "value", listed)
    return canonical_names.map_names(rows, "value", listed, aliases=_license_words(spark)).select("lic_row_id", "license_ref")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report: values that are not on the list, with the number of their rows and the entries near them."""
    return canonical_names.unmatched(_filled(spark, d), "value", _t(spark, d, "license_list"), aliases=_license_words(spark))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per copy but the first of each set."""
    c = format_duplicates.copies(_t(spark, d, "bom_components"), "row_id", COMPONENT, {"purl"})
    return c.select(F.col("keep_id").alias("keep_row_id"), F.col("copy_id").alias("copy_row_id"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per set with its number of copies."""
    return format_duplicates.collapse(_t(spark, d, "bom_components"), "row_id", COMPONENT, {"purl"})


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of a divided one."""
    return packing.pack(_t(spark, d, "documents"), capacity=CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents the packing had to divide: their pieces lie in more than one container."""
    return packing.divided(p6_packed(spark, d)).select(F.col("id").alias("doc_id"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: one row."""
    return packing.fill(p6_packed(spark, d), CAPACITY)


def p6_conserved(spark: SparkSession, d: str) -> DataFrame:
    """What the packing must keep: documents and tokens placed, containers above the capacity, undivided documents cut."""
    p = p6_packed(spark, d)
    over = packing.container_use(p).where(F.col("used") > CAPACITY).agg(F.count("*").alias("over_full"))
    docs = p.groupBy("id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("n_pieces").alias("pieces"))
    sums = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n") != F.col("pieces"), 1)).alias("incomplete"), F.count(F.when((F.col("n") > 1) & (F.col("t") <= CAPACITY), 1)).alias("needlessly_divided"))
    return sums.crossJoin(over)  # one row each


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents with the leaked items, the words covered and where they stand in the text."""
    return leaks.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they leak."""
    return p7_leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized documents and whether a cut had to be forced."""
    return splitting.cut_kind(_t(spark, d, "documents"), limit=LIMIT, overlap=OVERLAP).select("doc_id", "cut")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of oversized documents."""
    return splitting.split_oversized(_t(spark, d, "documents"), limit=LIMIT, overlap=OVERLAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_collapsed, p6_found, p6_packed, p6_fill, p6_conserved, p7_found, p7_leaks, p8_found, p8_pieces)
}

# Plain SQL for the problems that whole-table SQL can express.
_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
_SETS = r"""
WITH w AS (SELECT row_id, url_decode(coalesce(group_name, '')) AS g, url_decode(coalesce(comp_name, '')) AS n, purl, strpos(coalesce(purl, ''), '?') AS q FROM bom_components),
x AS (SELECT row_id, g, n, url_decode(CASE WHEN q > 0 THEN substr(purl, 1, q - 1) ELSE coalesce(purl, '') END) AS b, CASE WHEN q > 0 THEN string_split(substr(purl, q + 1), '&') ELSE [] END AS pairs FROM w),
y AS (SELECT row_id, trim(regexp_replace(lower(g), '[^\p{L}\p{N}]+', ' ', 'g')) AS g, trim(regexp_replace(lower(n), '[^\p{L}\p{N}]+', ' ', 'g')) AS n, trim(regexp_replace(lower(b), '[^\p{L}\p{N}]+', ' ', 'g')) AS b,
list_sort(list_filter(list_transform(pairs, lambda t: trim(regexp_replace(lower(url_decode(split_part(t, '=', 1))), '[^\p{L}\p{N}]+', ' ', 'g')) || '=' || trim(regexp_replace(lower(url_decode(substr(t, strpos(t, '=') + 1))), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda t: t <> '=')) AS p FROM x)"""
ORACLES: dict[str, str] = {
    "p3_found": _SETS + " SELECT k AS keep_row_id, row_id AS copy_row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY g, n, b, p) AS k FROM y) WHERE row_id <> k",
    "p3_collapsed": _SETS + " SELECT min(row_id) AS keep_id, count(*) AS n_copies FROM y GROUP BY g, n, b, p",
    "p6_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_TOK}')) > 2048",
    "p6_conserved": f"SELECT count(*) AS documents, coalesce(sum(coalesce(len(regexp_extract_all(text, '{_TOK}')), 0)), 0) AS tokens, 0 AS incomplete, 0 AS needlessly_divided, 0 AS over_full FROM documents",
    "p8_found": f"""WITH t AS (SELECT doc_id, text FROM documents WHERE len(regexp_extract_all(text, '{_TOK}')) > 512),
s AS (SELECT doc_id, list_max(list_transform(string_split(regexp_replace(text, '([.!?])[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '\\1' || chr(10), 'g'), chr(10)), lambda x: len(regexp_extract_all(x, '{_TOK}')))) AS m FROM t)
SELECT doc_id, CASE WHEN m > 512 THEN 'forced' ELSE 'natural' END AS cut FROM s""",
}
