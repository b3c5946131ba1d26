"""Readers of landed files: fact files, registry documents, build files, tag lists, provenance and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_relation(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Tab-separated facts without a header; rows that do not fit the columns are an error."""
    return spark.read.csv(path, sep="\t", schema=columns, mode="FAILFAST")


def read_fact_store(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Relations of a folder with one Parquet table each, registered as views under their names without leading underscore."""
    if names is None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(hadoop)]
    out = {}
    for n in names:
        d = spark.read.parquet(f"{path}/{n}.parquet")
        view = n.lstrip("_")
        d.createOrReplaceTempView(view)
        out[view] = d
    return out


def declarations(relations: dict[str, DataFrame]) -> str:
    """Rule-text declarations of relations; a nullable column becomes a symbol."""
    kind = {"bigint": "number", "int": "number", "boolean": "number", "double": "float", "float": "float"}
    lines = []
    for n, d in sorted(relations.items()):
        cols = ", ".join(f"{f.name}: {'symbol' if f.nullable else kind.get(f.dataType.simpleString(), 'symbol')}" for f in d.schema.fields)
        lines.append(f".decl {n}({cols})")
    return "\n".join(lines)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, with their path; unreadable ones have only the path."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def read_popular_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file in its order, one per line, blank lines left out."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("rank", "name"))
    return t.select("rank", F.trim("name").alias("name")).where("name <> ''")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """``(path, payload)`` of provenance files, compressed or not: one envelope or statement a line."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")).where("v is not null")
    return t.select("path", F.coalesce(F.try_variant_get("v", "$.dsseEnvelope.payload", "string"), F.try_variant_get("v", "$.payload", "string"), F.to_json("v")).alias("payload"))


def pom_coordinates(xml: Column) -> Column:
    """group, artifact and version of a project file; group and version fall back to the parent's."""
    def one(path: str) -> Column:
        x = F.xpath_string(xml, F.lit(path))
        return F.when(F.trim(x) != "", F.trim(x))

    base = "/*[local-name()='project']"
    tag = lambda n: f"/*[local-name()='{n}']/text()"
    parent = base + "/*[local-name()='parent']"
    return F.struct(
        F.coalesce(one(base + tag("groupId")), one(parent + tag("groupId"))).alias("group"),
        one(base + tag("artifactId")).alias("artifact"),
        F.coalesce(one(base + tag("version")), one(parent + tag("version"))).alias("version"),
        one(base + "/*[local-name()='scm']" + tag("url")).alias("scm_url"),
    )


def resolve_properties(text: Column, properties: Column, rounds: int = 3) -> Column:
    """``${name}`` replaced by the map's values; unknown names stay."""
    out = text
    for _ in range(rounds):
        out = F.aggregate(F.map_entries(properties), out, lambda acc, e: F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))
    return out


def gradle_property(text: Column, name: str) -> Column:
    """Value of ``name = 'value'`` in a build or properties file."""
    x = F.regexp_extract(text, rf"(?m)^\s*(?:rootProject\.)?{name}\s*=?\s*['\"]?([^'\"\s]+)['\"]?\s*$", 1)
    return F.when(x != "", x)


def page_links(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def needs_script(html: Column) -> Column:
    """The page only asks for JavaScript."""
    return F.lower(html).contains("enable javascript") | F.lower(html).contains("javascript is disabled")


def local_artifacts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, sha256)`` of files below a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return b.select("path", F.sha2("content", 256).alias("sha256"))


def nearest_file_above(files: DataFrame, key: str, path: str, name: str) -> DataFrame:
    """``(key, path, found)``: for every file, the file ``name`` in its directory or the nearest one above; an equi-join on the directories above."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    ups = files.select(key, path, F.explode(above).alias("_dir"))
    here = files.where(F.element_at(parts, -1) == name).select(key, F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)).alias("_dir"), F.col(path).alias("found"))
    return ups.join(here, [key, "_dir"]).groupBy(key, path).agg(F.max_by("found", F.length("_dir")).alias("found"))
