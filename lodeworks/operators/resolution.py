"""Where a package's source is: repository candidates, fallbacks, verification and build pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.urls import HOSTS, remote_url, same_repository_key


def first_valid(urls: Column, hosts: Sequence[str] = HOSTS) -> Column:
    """The first address of an array that is a repository on an allowed host, normalised."""
    return F.try_element_at(F.filter(F.transform(urls, lambda u: remote_url(u, hosts)), lambda u: u.isNotNull()), F.lit(1))


def find_repository(packages: DataFrame, key: str, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """``(key, repository, outcome)``: the first source column with a valid address.  ``sources``: (column of addresses, outcome)."""
    found = [(first_valid(F.col(c)), o) for c, o in sources]
    repo = F.coalesce(*[u for u, _ in found])
    outcome = F.coalesce(*[F.when(u.isNotNull(), F.lit(o)) for u, o in found], F.lit("no_repository"))
    return packages.select(key, repo.alias("repository"), outcome.alias("outcome"))


def latest_version_fallback(wanted: DataFrame, found: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """The source of a version, or of the latest version of its package where there is none; ``fallback`` says which."""
    a = found.select(key, "version", "repository")
    b = latest.select(key, F.col("repository").alias("_latest"))
    j = wanted.select(key, "version").join(a, [key, "version"], "left").join(b, key, "left")
    return j.select(key, "version", F.coalesce("repository", "_latest").alias("repository"), (F.col("repository").isNull() & F.col("_latest").isNotNull()).alias("fallback"))


def same_repository(a: Column, b: Column) -> Column:
    """Equal host and path."""
    return F.coalesce(same_repository_key(a) == same_repository_key(b), F.lit(False))


def artifact_pipeline(releases: DataFrame, runs: DataFrame, commits: DataFrame, now: str, window_seconds: int = 3600, retention_days: int = 400) -> DataFrame:
    """``(package, seq, run_id, published_before_commit, run_deleted)``: the run that probably published a release.

    A run counts if it started within the window before the release and within half the window of the commit; the latest
    one stands.  A release from before its commit was not made from it; without a run, one older than the retention may
    have been deleted.  ``commits(package, seq, committed_at)``.
    """
    from lodeworks.operators.relational import ci_runs_before_publish

    near = ci_runs_before_publish(runs, releases, window_seconds).join(commits, ["package", "seq"])
    near = near.where(F.expr(f"abs(timestampdiff(SECOND, committed_at, started_at)) <= {window_seconds // 2}"))
    w = Window.partitionBy("package", "seq").orderBy(F.col("started_at").desc(), "run_id")
    best = near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("package", "seq", "run_id")
    j = releases.select("package", "seq", "upload_time").join(commits, ["package", "seq"]).join(best, ["package", "seq"], "left")
    gone = F.col("run_id").isNull() & F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {retention_days} DAYS > upload_time")
    return j.select("package", "seq", "run_id", (F.col("upload_time") < F.col("committed_at")).alias("published_before_commit"), gone.alias("run_deleted"))


def nearest_ancestor(nodes: DataFrame, kind: str, max_rounds: int = 64) -> DataFrame:
    """``(node, ancestor)``: the nearest ancestor of a kind in a forest ``(node, parent, kind)``, the node itself included.

    Every round doubles how far up each node has looked, so the rounds grow with the logarithm of the depth; a cycle
    without a node of the kind is an error.
    """
    from lodeworks.operators.graph import NoFixpoint
    from lodeworks.session import cut

    hit = F.coalesce(F.col("kind") == kind, F.lit(False))
    state = cut(nodes.select("node", F.when(hit, F.col("node")).otherwise(F.col("parent")).alias("at"), hit.alias("done")).where("at is not null"))
    for _ in range(max_rounds):
        still = state.where("not done")
        if still.isEmpty():
            return state.select("node", F.col("at").alias("ancestor"))
        # A node whose target has nothing above it has no such ancestor and goes.
        up = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("done").alias("there"))
        state = cut(state.where("done").unionByName(still.join(up, "at").select("node", F.col("further").alias("at"), F.col("there").alias("done"))))
    raise NoFixpoint("the nodes above some node form a cycle")


def matching_run(wanted: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """``(key, run_id)``: the first run of the workflow on the commit; ``wanted(key, workflow_id, head_sha)``, ``runs(run_id, workflow_id, head_sha, n)``.

    ``n`` is the place of a run in the listing.
    """
    j = wanted.join(runs, ["workflow_id", "head_sha"])
    return j.groupBy(key).agg(F.min_by("run_id", F.struct("n", "run_id")).alias("run_id"))


def source_report(df: DataFrame, key: str) -> DataFrame:
    """Adds ``report``: the source of a package, its commit and where they came from, as a JSON document."""
    return df.withColumn("report", F.to_json(F.struct(*[F.col(c) for c in df.columns if c != key])))
