"""Bills of materials: component tables and their dependencies resolved to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM_SCHEMA = "metadata struct<component struct<`bom-ref` string, purl string>>, components array<struct<`bom-ref` string, group string, name string, version string, purl string, type string>>, dependencies array<struct<ref string, dependsOn array<string>>>"


def parsed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, bom)``; documents that are no complete JSON are left out."""
    return df.select(F.col(id_col).alias("id"), F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, BOM_SCHEMA)).alias("bom")).where("bom is not null")


def components(p: DataFrame) -> DataFrame:
    """``(id, ref, group, name, version, purl)`` of the top level, each reference once."""
    return p.select("id", F.explode("bom.components").alias("c")).select("id", F.col("c.`bom-ref`").alias("ref"), "c.group", "c.name", "c.version", "c.purl").where("ref is not null").dropDuplicates(["id", "ref"])


def dependencies(p: DataFrame, direct_only: bool = False) -> DataFrame:
    """``(id, parent_ref, child_ref)``; only those of the described component if asked."""
    e = p.select("id", F.col("bom.metadata.component.`bom-ref`").alias("root"), F.explode("bom.dependencies").alias("d")).select("id", "root", F.col("d.ref").alias("parent_ref"), F.explode("d.dependsOn").alias("child_ref"))
    return (e.where("parent_ref = root") if direct_only else e).select("id", "parent_ref", "child_ref").distinct()


def resolved(p: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Dependencies whose child is a listed component, without those that are modules of the project itself (``id, ref``)."""
    c = components(p).select("id", F.col("ref").alias("child_ref"), "purl", "name", "version")
    out = dependencies(p).join(c, ["id", "child_ref"])
    return out.join(modules.select("id", F.col("ref").alias("child_ref")), ["id", "child_ref"], "left_anti") if modules is not None else out
