"""Joins, best-of-group selections and reports over the fact store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts each partition to them before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_components(component: DataFrame, analysis: DataFrame) -> DataFrame:
    """The component of the latest analysis of each purl; equal times: the greatest id."""
    j = component.join(analysis.withColumnRenamed("id", "analysis_id"), "analysis_id")
    return first_per_group(j, ["purl"], [F.col("analysis_time").desc(), F.col("id").desc()])


def facts_chain(component: DataFrame, check_result: DataFrame, check_facts: DataFrame, table: DataFrame, required: str | None = None) -> DataFrame:
    """component - check result - check facts - one fact table, of rows whose ``required`` column is filled."""
    t = table.where(F.col(required).isNotNull()) if required else table
    cr = check_result.select(F.col("id").alias("check_result_id"), F.col("component_id").alias("cid"))
    cf = check_facts.select("id", "confidence", "check_result_id")
    return t.join(cf, "id").join(cr, "check_result_id").join(component.select(F.col("id").alias("cid"), "purl"), "cid").withColumnRenamed("cid", "component_id")


def best_command_per_tool(facts: DataFrame, keys: Sequence[str] = ("component_id", "build_tool_name")) -> DataFrame:
    """The fact of highest confidence of every group, the smallest id on a tie."""
    return first_per_group(facts, keys, [F.col("confidence").desc(), F.col("id").asc()])


def fallback_chain(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has any for a key."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    least = out.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return out.join(least, [key, "source_rank"], "left_semi")


def failed_diagnostics(component: DataFrame, analysis: DataFrame, check_result: DataFrame, check_facts: DataFrame) -> DataFrame:
    """Facts of checks that did not pass, with their component and analysis."""
    return (
        check_facts.select("check_result_id", "confidence")
        .join(check_result.where("passed = 0").select(F.col("id").alias("check_result_id"), "check_id", "component_id"), "check_result_id")
        .join(component.select(F.col("id").alias("component_id"), "purl", "analysis_id"), "component_id")
        .join(analysis.select(F.col("id").alias("analysis_id"), "analysis_time"), "analysis_id")
    )


def priority_bucket(priority: Column) -> Column:
    """critical, high, medium or low."""
    return F.when(priority >= 90, "critical").when(priority >= 70, "high").when(priority >= 50, "medium").otherwise("low")


def common_purl(df: DataFrame, key: str) -> DataFrame:
    """The purl type, name and version on which all rows of a key agree; null where they differ."""
    def agreed(c: str) -> Column:
        same = (F.count_distinct(c) <= 1) & ((F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0))
        return F.when(same, F.first(c, ignorenulls=True)).alias(c)

    return df.groupBy(key).agg(*map(agreed, ("type", "name", "version")))


def attributes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entity-attribute-value form: ``(*keys, attribute, value)``, values as text."""
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(list(keys), cols, "attribute", "value")


def foreign_attributes(left: DataFrame, left_key: str, fk: str, right: DataFrame, right_key: str, columns: Sequence[str], parity: bool = False) -> DataFrame:
    """Attributes of the row that ``fk`` points to, as ``(id, attribute, value)``.

    ``parity`` leaves the foreign key unbound: every left row gets every right value (a cross product, for small inputs
    only; it exists to reproduce results that were made that way).
    """
    r = attributes(right.select(right_key, *columns), [right_key])
    if parity:
        return left.select(F.col(left_key).alias("id")).crossJoin(r.select("attribute", "value")).distinct()
    r = r.withColumnRenamed(right_key, "_fk")
    return left.select(F.col(left_key).alias("id"), F.col(fk).alias("_fk")).join(r, "_fk").select("id", "attribute", "value")


def stronger_confidence(facts: DataFrame, key: str, kind: str, stronger: str, weaker: str) -> DataFrame:
    """Keys whose best ``stronger`` fact has more confidence than some ``weaker`` fact.

    The inequality self-join needs only the greatest and the least value of each side, so it is one aggregation.
    """
    a = F.max(F.when(F.col(kind) == stronger, F.col("confidence")))
    b = F.min(F.when(F.col(kind) == weaker, F.col("confidence")))
    return facts.groupBy(key).agg(a.alias("strong"), b.alias("weak")).where("strong > weak").select(key, "strong", "weak")


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def resolve_table(spark: SparkSession, name: str) -> str | None:
    """The table of this name or the one with an underscore in front."""
    return next((n for n in (name, f"_{name}") if spark.catalog.tableExists(n)), None)


def justification(columns: dict[str, str], default: str = "Not Available.") -> Column:
    """Non-null columns as ``name: value`` texts, tagged as text or link; a default if there are none."""
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{tag}:{c}="), F.col(c).cast("string"))) for c, tag in columns.items()]))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(default)))


def single_or_null(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of keys with exactly one row; null for keys with several."""
    return rows.groupBy(key).agg(F.when(F.count("*") == 1, F.first(value)).alias(value))


def ci_runs_before_publish(runs: DataFrame, releases: DataFrame, window_seconds: int) -> DataFrame:
    """Runs of a package that started within the window before a release.

    The interval is cut into buckets of its own length, so the join is an equi-join on package and bucket: each release
    meets the runs of two buckets, never all runs of its package.
    """
    def secs(c: str) -> Column:
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")

    r = runs.select("package", "run_id", "started_at", "conclusion", F.floor(secs("started_at") / window_seconds).alias("b"))
    p = releases.select("package", "seq", "upload_time", F.floor(secs("upload_time") / window_seconds).alias("pb")).withColumn("b", F.explode(F.array(F.col("pb"), F.col("pb") - 1)))
    inside = (F.col("started_at") < F.col("upload_time")) & F.expr(f"started_at >= upload_time - INTERVAL {window_seconds} SECONDS")
    return p.join(r, ["package", "b"]).where(inside).select("package", "seq", "run_id", "conclusion", "started_at", "upload_time")


def with_retention(df: DataFrame, column: str, now: str, days: int = 400) -> DataFrame:
    """Adds ``expired``: older than the days that run logs are kept."""
    return df.withColumn("expired", F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {days} DAYS > {column}"))
