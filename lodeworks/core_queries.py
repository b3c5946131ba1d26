"""Queries of the general problems 2, 4 and 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import nesting, schema_drift, timestamps


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TIME_COLUMNS = {"release_files": ("file_id", ["upload_time", "upload_time_iso_8601"]), "advisories": ("adv_num", ["published", "modified"])}


def _times(spark: SparkSession, d: str, only_cases: bool) -> DataFrame:
    rules = timestamps.zone_rules(_t(spark, d, "registries"))
    parts = []
    for src, (id_col, columns) in TIME_COLUMNS.items():
        df = _t(spark, d, src)
        long = df.select(
            F.lit(src).alias("src"), F.col(id_col).alias("rec_id"), "registry",
            F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in columns])).alias("x"),
        ).select("src", "rec_id", "registry", "x.field", "x.raw")
        parts.append(long)
    long = parts[0].unionByName(parts[1])
    if only_cases:
        long = long.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(timestamps.CANONICAL))
    return long.withColumn("utc_us", timestamps.utc_micros(F.col("raw"), F.col("registry"), rules))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that denote a moment and are not written canonically, with their instant."""
    return _times(spark, d, True).where("utc_us is not null").select("src", "rec_id", "field", "utc_us")


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    """All four columns: the instant of each value, or why there is none, and the version of the zone data used."""
    return _times(spark, d, False).select("src", "rec_id", "field", "utc_us", F.when(F.col("raw").isNull(), "null").when(F.col("utc_us").isNull(), "unreadable").otherwise("moment").alias("status"), F.lit(timestamps.zone_data_version()).alias("zone_data"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a file's fields against the file before it in its feed."""
    return schema_drift.changes(_t(spark, d, "feed_lines")).select(F.col("producer").alias("feed"), F.col("seq").alias("file_seq"), "change", "field", "new_field")


def p4_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """Lifespans of every feed, field and type."""
    return schema_drift.lifespans(schema_drift.catalogue(_t(spark, d, "feed_lines"))).select("producer", "field", "kind", "first_seq", "last_seq", "files")


def _aliases(lines: DataFrame) -> schema_drift.Aliases:
    drift = schema_drift.Drift(lines)
    return schema_drift.Aliases(drift.changes(), drift.catalogue)


def _p4_table(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = _t(spark, d, "feed_lines").where(F.col("feed_kind") == kind)
        return schema_drift.unified(lines, _aliases(lines), keep=("line_id",))

    query.__doc__ = f"All records of the {kind} feeds in one table."
    return query


def _p4_values(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = _t(spark, d, "feed_lines").where(F.col("feed_kind") == kind)
        return schema_drift.long_values(lines, _aliases(lines), "line_id")

    query.__doc__ = f"The filled cells of the one table of the {kind} feeds."
    return query


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Hashes, references, ranges and digests, linked to the object that holds them."""
    docs, atts = _t(spark, d, "bom_documents"), _t(spark, d, "attestations")
    boms = nesting.relations(docs, "bom_num", "bom_json", nesting.graph_of(docs, "bom_json", nesting.BOM), {"hashes", "externalReferences"})
    digests = nesting.relations(atts, "att_num", "payload", nesting.graph_of(atts, "payload", nesting.STATEMENT), {"digest"})
    ranges = nesting.typed_table(_t(spark, d, "advisories"), "adv_num", ["affected"], "ranges")
    return (
        nesting.leaves(boms, "bom_documents", {"hashes": "content", "externalReferences": "url"})
        .unionByName(nesting.leaves(digests, "attestations", {}, ("digest",)))
        .unionByName(ranges.where("type is not null").select(F.lit("advisories").alias("src"), "rec_id", "parent_path", F.lit("ranges").alias("child_kind"), F.col("pos").cast("long").alias("child_pos"), F.col("type").alias("child_value")))
    )


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of all components of all documents with their parent links."""
    docs = _t(spark, d, "bom_documents")
    rel = nesting.relations(docs, "bom_num", "bom_json", nesting.graph_of(docs, "bom_json", nesting.BOM), {"components"})
    return nesting.table(rel, "components", ["bom-ref", "type", "group", "name", "version", "purl"])


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of the ranges of advisories with their parent links."""
    return nesting.typed_table(_t(spark, d, "advisories"), "adv_num", ["affected"], "ranges")


def p5_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Documents and statements that give no rows, with the reason."""
    boms = nesting.unreadable(_t(spark, d, "bom_documents"), "bom_num", "bom_json").select(F.lit("bom_documents").alias("src"), "*")
    return boms.unionByName(nesting.unreadable(_t(spark, d, "attestations"), "att_num", "payload").select(F.lit("attestations").alias("src"), "*"))


def p5_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    """The schema graph of the documents, which element types get a table, and whether the format declares the edge."""
    edges = nesting.graph_of(_t(spark, d, "bom_documents"), "bom_json", nesting.BOM)
    plan, known = nesting.shared_inlining(edges), {(e.parent, e.child) for e in nesting.BOM}
    return spark.createDataFrame([(e.parent, e.child, e.repeated, e.child in plan.tables, (e.parent, e.child) in known) for e in edges], "parent string, child string, repeated boolean, own_table boolean, declared boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_normalised": p2_normalised,
    "p4_found": p4_found,
    "p4_lifespans": p4_lifespans,
    "p4_bom_table": _p4_table("bom"),
    "p4_att_table": _p4_table("att"),
    "p4_bom_values": _p4_values("bom"),
    "p4_att_values": _p4_values("att"),
    "p5_found": p5_found,
    "p5_components": p5_components,
    "p5_ranges": p5_ranges,
    "p5_unreadable": p5_unreadable,
    "p5_schema_graph": p5_schema_graph,
}

#: The same changes by self-joins over whole tables.
ORACLES: dict[str, str] = {
    "p4_found": """
WITH l AS (SELECT feed, file_seq, line FROM feed_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
e AS (SELECT feed, file_seq, k, json_extract_string(line, '$.ref') AS ref, json_extract(line, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(line)) AS k FROM l)),
t AS (SELECT DISTINCT feed, file_seq, k, ref, CAST(v AS VARCHAR) AS v, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS ty FROM e WHERE json_type(v) <> 'NULL'),
files AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed, file_seq FROM feed_lines)),
p AS (SELECT feed, file_seq, k, list_sort(list(DISTINCT ty)) AS ty FROM t GROUP BY ALL),
gone AS (SELECT f.feed, f.file_seq, f.prev, p.k FROM files f JOIN p ON p.feed = f.feed AND p.file_seq = f.prev WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.feed = f.feed AND q.file_seq = f.file_seq AND q.k = p.k)),
come AS (SELECT f.feed, f.file_seq, p.k FROM files f JOIN p ON p.feed = f.feed AND p.file_seq = f.file_seq WHERE f.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.feed = f.feed AND q.file_seq = f.prev AND q.k = p.k)),
ren AS (SELECT g.feed, g.file_seq, g.k, c.k AS n FROM gone g JOIN come c ON c.feed = g.feed AND c.file_seq = g.file_seq JOIN t a ON a.feed = g.feed AND a.file_seq = g.prev AND a.k = g.k
JOIN t b ON b.feed = g.feed AND b.file_seq = g.file_seq AND b.k = c.k AND b.ref = a.ref GROUP BY ALL HAVING avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) >= 0.9)
SELECT feed, file_seq, 'renamed' AS change, k AS field, n AS new_field FROM ren
UNION ALL SELECT feed, file_seq, 'removed', k, '' FROM gone WHERE (feed, file_seq, k) NOT IN (SELECT (feed, file_seq, k) FROM ren)
UNION ALL SELECT feed, file_seq, 'added', k, '' FROM come WHERE (feed, file_seq, k) NOT IN (SELECT (feed, file_seq, n) FROM ren)
UNION ALL SELECT f.feed, f.file_seq, 'type_changed', p.k, '' FROM files f JOIN p ON p.feed = f.feed AND p.file_seq = f.file_seq JOIN p q ON q.feed = f.feed AND q.file_seq = f.prev AND q.k = p.k WHERE p.ty <> q.ty""",
}


#: An object as the statements write it; texts of objects have their keys sorted.
SUBJECT = r'\{"name":("[^"]*"),"digest":(\{[^}]*\})\}'


def _values_sql(kind: str) -> str:
    """The one table by self-joins: columns are the components of the renames, cells the values of the lines."""
    body = ORACLES["p4_found"]
    common = body[: body.index("SELECT feed, file_seq, 'renamed'")].replace("WITH l AS", "WITH RECURSIVE l AS").replace("FROM feed_lines", f"FROM (SELECT * FROM feed_lines WHERE feed_kind = '{kind}')")
    return common + f""", fields AS (SELECT k, count(DISTINCT (feed, file_seq)) AS files FROM t GROUP BY 1),
links AS (SELECT DISTINCT k AS a, n AS b FROM ren UNION SELECT DISTINCT n, k FROM ren),
reach AS (SELECT k AS f, k AS g FROM fields UNION SELECT reach.f, links.b FROM reach JOIN links ON links.a = reach.g),
named AS (SELECT f, first(g ORDER BY files DESC, g) AS col FROM reach JOIN fields ON fields.k = g GROUP BY 1),
place AS (SELECT feed, file_seq, k, CASE WHEN row_number() OVER (PARTITION BY feed, file_seq, col ORDER BY files DESC, k) = 1 THEN col ELSE k END AS col FROM (SELECT DISTINCT feed, file_seq, k FROM t) JOIN named ON named.f = k JOIN fields USING (k)),
cells AS (SELECT feed, file_seq, line_id, k, json_extract(line, '$."' || k || '"') AS v FROM (SELECT feed, file_seq, line_id, line, unnest(json_keys(line)) AS k FROM feed_lines WHERE feed_kind = '{kind}' AND json_valid(line) AND json_type(line) = 'OBJECT'))
SELECT feed, file_seq, line_id, col AS "column", CASE WHEN json_type(v) = 'DOUBLE' THEN regexp_replace(CAST(v AS VARCHAR), '[.]?0+$', '') ELSE regexp_replace(json_extract_string(v, '$'), '{SUBJECT}', '{{"digest":\\2,"name":\\1}}', 'g') END AS value FROM cells JOIN place USING (feed, file_seq, k) WHERE json_type(v) <> 'NULL'"""


ORACLES |= {f"p4_{kind}_values": _values_sql(kind) for kind in ("bom", "att")}
