"""The relational fact store: typed relations, and their projection from the star-schema tables.

Relations are plain DataFrames; ``Facts`` builds each one on first use and registers views on request, so that rule text
and SQL can refer to them by name.  ``FACTS_SQL`` states the same projection in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Check ids by line number (fixed values of the fact model).
CHECK_IDS = {
    1: "mcn_version_control_system_1",
    2: "mcn_build_service_1",
    3: "mcn_build_script_1",
    4: "mcn_build_as_code_1",
    5: "mcn_provenance_level_three_1",
    6: "mcn_trusted_builder_level_three_1",
    7: "mcn_provenance_expectation_1",
}
#: The instant against which ages are counted: queries never read the clock.
NOW = "2024-12-31 00:00:00"

FACTS_SQL = """
WITH RECURSIVE analysis AS (
  SELECT n_nationkey AS id, TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS analysis_time FROM nation
), component AS (
  SELECT p_partkey AS id, 'pkg:' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '@' || p_size AS purl,
         p_partkey % 25 AS analysis_id, lower(p_type) AS type, replace(p_name, ' ', '-') AS name,
         CAST(p_size AS VARCHAR) AS version FROM part
), dependency AS (
  SELECT p.p_partkey AS parent, p.p_partkey + CASE WHEN p.p_partkey % 5 = 0 THEN 2 ELSE 1 END AS child
  FROM part p WHERE p.p_partkey % 5 < 3
    AND EXISTS (SELECT 1 FROM part c WHERE c.p_partkey = p.p_partkey + CASE WHEN p.p_partkey % 5 = 0 THEN 2 ELSE 1 END)
  UNION
  SELECT p.p_partkey, p.p_partkey + 1 FROM part p WHERE p.p_partkey % 5 = 0
    AND EXISTS (SELECT 1 FROM part c WHERE c.p_partkey = p.p_partkey + 1)
), dependency_deep AS (
  SELECT a.p_partkey AS parent, c.p_partkey AS child FROM part a JOIN part c ON c.p_partkey = a.p_partkey // 2 WHERE a.p_partkey >= 1
  UNION
  SELECT a.p_partkey, c.p_partkey FROM part a JOIN part c ON c.p_partkey = a.p_partkey // 3 WHERE a.p_partkey >= 1
), check_base AS (
  SELECT l_partkey AS component_id, l_linenumber AS ln, count(*) AS n,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, round(avg(l_discount), 6) AS d
  FROM lineitem GROUP BY l_partkey, l_linenumber
), check_result AS (
  SELECT component_id * 7 + ln AS id,
         CASE ln WHEN 1 THEN 'mcn_version_control_system_1' WHEN 2 THEN 'mcn_build_service_1' WHEN 3 THEN 'mcn_build_script_1'
                 WHEN 4 THEN 'mcn_build_as_code_1' WHEN 5 THEN 'mcn_provenance_level_three_1'
                 WHEN 6 THEN 'mcn_trusted_builder_level_three_1' ELSE 'mcn_provenance_expectation_1' END AS check_id,
         CASE WHEN 2 * returned <= n THEN 1 ELSE 0 END AS passed, component_id FROM check_base
), check_facts AS (
  SELECT component_id * 7 + ln AS id, CASE WHEN d < 0.04 THEN 1.0 WHEN d < 0.06 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence,
         component_id, component_id * 7 + ln AS check_result_id FROM check_base
), repository AS (
  SELECT s_suppkey AS id, s_suppkey AS component_id,
         'github.com/org' || s_nationkey || '/repo' || s_suppkey AS complete_name,
         'https://github.com/org' || s_nationkey || '/repo' || s_suppkey AS remote_path FROM supplier
), releases AS (
  SELECT user_id AS package, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS upload_time, md5(props) AS digest
  FROM events WHERE event_type = 'purchase'
), ci_runs AS (
  SELECT event_id AS run_id, user_id AS package, ts AS started_at, event_type AS conclusion FROM events WHERE event_type IN ('view', 'click', 'error')
)"""


class Facts:
    """Relations of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def analysis(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, n_nationkey)").alias("analysis_time"))

    @cached_property
    def component(self) -> DataFrame:
        name = F.regexp_replace("p_name", " ", "-")
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("pkg:"), F.lower("p_type"), F.lit("/"), name, F.lit("@"), F.col("p_size").cast("string")).alias("purl"),
            (F.col("p_partkey") % 25).alias("analysis_id"),
            F.lower("p_type").alias("type"),
            name.alias("name"),
            F.col("p_size").cast("string").alias("version"),
        )

    @cached_property
    def dependency(self) -> DataFrame:
        """Short acyclic chains: blocks of five components."""
        ids = self.table("part").select(F.col("p_partkey").alias("parent"))
        m = F.col("parent") % 5
        steps = F.when(m == 0, F.array(F.lit(1), F.lit(2))).when(m < 3, F.array(F.lit(1)))
        edges = ids.select("parent", F.explode(steps).alias("s")).select("parent", (F.col("parent") + F.col("s")).alias("child"))
        return edges.join(ids.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child").distinct()

    @cached_property
    def dependency_deep(self) -> DataFrame:
        """Acyclic graph of logarithmic depth."""
        ids = self.table("part").select(F.col("p_partkey").alias("parent"))
        edges = ids.where("parent >= 1").select("parent", F.explode(F.array(F.expr("parent div 2"), F.expr("parent div 3"))).alias("child"))
        return edges.join(ids.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child").distinct()

    @cached_property
    def _checks(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("component_id"), F.col("l_linenumber").alias("ln"))
            .agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.round(F.avg("l_discount"), 6).alias("d"))
            .withColumn("id", F.col("component_id") * 7 + F.col("ln"))
        )

    @cached_property
    def check_result(self) -> DataFrame:
        name = F.coalesce(*[F.when(F.col("ln") == k, v) for k, v in CHECK_IDS.items()])
        return self._checks.select("id", name.alias("check_id"), (2 * F.col("returned") <= F.col("n")).cast("int").alias("passed"), "component_id")

    @cached_property
    def check_facts(self) -> DataFrame:
        confidence = F.when(F.col("d") < 0.04, 1.0).when(F.col("d") < 0.06, 0.7).otherwise(0.4)
        return self._checks.select("id", confidence.alias("confidence"), "component_id", F.col("id").alias("check_result_id"))

    @cached_property
    def repository(self) -> DataFrame:
        name = F.concat(F.lit("github.com/org"), F.col("s_nationkey").cast("string"), F.lit("/repo"), F.col("s_suppkey").cast("string"))
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("component_id"), name.alias("complete_name"), F.concat(F.lit("https://"), name).alias("remote_path"))

    @cached_property
    def releases(self) -> DataFrame:
        from pyspark.sql.window import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").where("event_type = 'purchase'").select(F.col("user_id").alias("package"), F.row_number().over(w).alias("seq"), F.col("ts").alias("upload_time"), F.md5("props").alias("digest"))

    @cached_property
    def ci_runs(self) -> DataFrame:
        return self.table("events").where(F.col("event_type").isin("view", "click", "error")).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("package"), F.col("ts").alias("started_at"), F.col("event_type").alias("conclusion"))

    RELATIONS = ("analysis", "component", "dependency", "dependency_deep", "check_result", "check_facts", "repository", "releases", "ci_runs")

    def register_views(self, *names: str) -> None:
        """Temporary views of the relations, all or those named."""
        for n in names or self.RELATIONS:
            getattr(self, n).createOrReplaceTempView(n)
