"""Writers of results: relations, facts, reports and attestations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relations(relations: Mapping[str, DataFrame], path: str) -> None:
    """Each relation as tab-separated text in a folder of its name."""
    for n, d in relations.items():
        d.select([F.col(c).cast("string") for c in d.columns]).write.mode("overwrite").csv(f"{path}/{n}", sep="\t")


def append_facts(results: DataFrame, path: str) -> None:
    """Check results and facts, appended to a store that is partitioned by check, so that reads of one check skip the others."""
    results.repartition("check_id").write.mode("append").partitionBy("check_id").parquet(path)


def json_report(df: DataFrame, key: str) -> DataFrame:
    """``(key, report)``: all rows of a key as one JSON document, in the order of their columns."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.to_json(F.struct(F.col(key).alias(key), F.array_sort(F.collect_list(F.struct(*cols))).alias("results"))).alias("report"))


def policy_report(verdicts) -> DataFrame:
    """``(relation, rows)``: the four verdict relations with all values as texts."""
    parts = []
    for n, d in zip(("passed_policies", "failed_policies", "component_satisfies_policy", "component_violates_policy"), verdicts[:4], strict=True):
        parts.append(d.select(F.lit(n).alias("relation"), F.array(*[F.col(c).cast("string") for c in d.columns]).alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown_rows(df: DataFrame, columns: Sequence[str], order: Sequence, limit: int = 10) -> DataFrame:
    """The first rows of a report table as Markdown lines."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")) for c in columns]
    return df.orderBy(*order).limit(limit).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def dockerfile(df: DataFrame) -> DataFrame:
    """Adds ``dockerfile`` for rows ``(python_version, repository, commit, command)``."""
    return df.withColumn("dockerfile", F.format_string("FROM python:%s-slim\nRUN git clone %s /src && git -C /src checkout --force %s\nWORKDIR /src\nRUN %s\n", "python_version", "repository", "commit", "command"))


def html_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``html``: each row as a table row of an HTML report, texts escaped."""
    def cell(c: str):
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), t, F.lit("</td>"))

    return df.withColumn("html", F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")))


def dot_edges(edges: DataFrame, src: str = "parent", dst: str = "child") -> DataFrame:
    """``(line)``: the edges of a graph as lines of a dot file, for a writer that puts them between its braces."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit(r"\"")), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), name(src), F.lit(" -> "), name(dst), F.lit(";")).alias("line"))


def flat_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, value)``: the leaves of a JSON object of one or two levels, for report tables."""
    v = df.select(key, F.try_parse_json(text).alias("_v")).where("_v is not null")
    top = v.select(key, F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("a", "_x"))
    inner = F.try_variant_get("_x", "$", "map<string,string>")
    leaves = F.when(inner.isNotNull(), F.transform(F.map_entries(inner), lambda e: F.struct(F.concat("a", F.lit("."), e["key"]).alias("path"), e["value"].alias("value")))).otherwise(F.array(F.struct(F.col("a").alias("path"), F.try_variant_get("_x", "$", "string").alias("value"))))
    return top.select(key, F.explode(leaves).alias("l")).select(key, "l.path", "l.value")
