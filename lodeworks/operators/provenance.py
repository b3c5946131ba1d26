"""Provenance: repository and commit, invocation and subjects of a statement; verification summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.urls import clean_spdx_uri, parse_purl

#: Digest algorithms that name a commit (fixed values).
COMMIT_DIGESTS = ("sha1", "gitCommit")


def decoded(payload: Column) -> Column:
    """Text of a payload that is JSON itself or base64 of it, in either alphabet, with or without padding."""
    t = F.trim(payload)
    b = F.regexp_replace(F.translate(F.regexp_replace(t, r"\s", ""), "-_", "+/"), "=+$", "")
    padded = F.concat(b, F.repeat(F.lit("="), (4 - F.length(b) % 4) % 4))
    return F.when(t.startswith("{"), t).when(b.rlike("^[A-Za-z0-9+/]+$") & (F.length(b) % 4 != 1), F.decode(F.unbase64(padded), "utf-8"))


def statement(payload: Column) -> Column:
    """VARIANT of a statement, null if it is not complete JSON."""
    return F.try_parse_json(decoded(payload))


def _s(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def _digest(v: str, path: str) -> Column:
    return F.coalesce(*[_s(v, f"{path}.{a}") for a in COMMIT_DIGESTS])


def source_of(df: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``repository`` and ``commit`` of a statement by the dialect of its predicate.

    v0.1: the material the recipe points to (index 0 counts); v0.2: the config source; v1: the workflow repository or the
    cloud build source, with the digest of the resolved dependency of the same address.
    """
    kind = _s(v, "$.predicateType")
    uri = lambda p: clean_spdx_uri(_s(v, p))
    index = F.try_variant_get(F.col(v), "$.predicate.recipe.definedInMaterial", "int")
    materials = F.try_variant_get(F.col(v), "$.predicate.materials", "array<struct<uri:string,digest:map<string,string>>>")
    deps = F.try_variant_get(F.col(v), "$.predicate.buildDefinition.resolvedDependencies", "array<struct<uri:string,digest:map<string,string>>>")
    here = F.when(index >= 0, F.try_element_at(materials, index + 1))
    v1_repo = F.coalesce(
        _s(v, "$.predicate.buildDefinition.externalParameters.workflow.repository"),
        _s(v, "$.predicate.buildDefinition.externalParameters.sourceToBuild.repository"),
        _s(v, "$.predicate.buildDefinition.externalParameters.configSource.repository"),
        _s(v, "$.predicate.buildDefinition.externalParameters.source"),
    )
    same = F.try_element_at(F.filter(deps, lambda d: clean_spdx_uri(d["uri"]) == clean_spdx_uri(F.col("_repo1"))), F.lit(1))
    d = lambda s: F.coalesce(*[s["digest"][a] for a in COMMIT_DIGESTS])
    old, mid, new, pypi = kind.rlike(r"v0\.1$"), kind.rlike(r"v0\.2$"), kind.rlike(r"/v1$") & ~kind.contains("publish"), kind.contains("publish")
    return (
        df.withColumn("_repo1", v1_repo)
        .withColumn("repository", F.when(old, clean_spdx_uri(here["uri"])).when(mid, uri("$.predicate.invocation.configSource.uri")).when(pypi, _s(v, "$.predicate.sourceUri")).when(new, F.col("_repo1")))
        .withColumn("commit", F.when(old, d(here)).when(mid, _digest(v, "$.predicate.invocation.configSource.digest")).when(pypi, _s(v, "$.predicate.sourceDigest")).when(new, F.coalesce(d(same), _s(v, "$.predicate.buildDefinition.internalParameters.buildEnvVar.BLD_COMMIT_HASH"))))
        .drop("_repo1")
    )


def build_type(v: str = "v") -> Column:
    return F.coalesce(_s(v, "$.predicate.buildType"), _s(v, "$.predicate.buildDefinition.buildType"))


def invocation_of(v: str = "v") -> Column:
    """Struct of workflow and run of the statement's build."""
    repo = clean_spdx_uri(_s(v, "$.predicate.invocation.configSource.uri"))
    run = F.coalesce(_s(v, "$.predicate.invocation.environment.github_run_id"), _s(v, "$.predicate.invocation.environment.GITHUB_RUN_ID"))
    workflow = F.coalesce(_s(v, "$.predicate.buildDefinition.externalParameters.workflow.path"), _s(v, "$.predicate.invocation.configSource.entryPoint"))
    return F.struct(workflow.alias("workflow"), F.coalesce(_s(v, "$.predicate.runDetails.metadata.invocationId"), F.when(run.isNotNull(), F.concat(repo, F.lit("/actions/runs/"), run))).alias("run"))


def subjects(df: DataFrame, id_col: str, v: str = "v") -> DataFrame:
    """``(id, pos, name, sha256)`` of every subject."""
    arr = F.try_variant_get(F.col(v), "$.subject", "array<struct<name:string,digest:map<string,string>>>")
    return df.select(id_col, F.posexplode(arr).alias("pos", "s")).select(id_col, "pos", F.col("s.name").alias("name"), F.col("s.digest")["sha256"].alias("sha256"))


def subject_matches(name: Column, purl: Column) -> Column:
    """A subject named as the file of a package: ``name-version`` with any suffix."""
    p = parse_purl(purl)
    return F.coalesce(F.element_at(F.split(name, "/"), -1).startswith(F.concat(p["name"], F.lit("-"), p["version"])), F.lit(False))


def conflicts(given: Column, from_provenance: Column) -> Column:
    """Both are known and differ."""
    return F.coalesce(given != from_provenance, F.lit(False))


def verification_summary(satisfied: DataFrame, violated: DataFrame, policy: str, digests: DataFrame) -> DataFrame:
    """``(purl, component_id, sha256, statement)`` for components that satisfy a policy no component violates.

    Of several components of one purl the greatest id stands.  ``digests(component_id, sha256)``: a component with two is
    left out, one without has a null digest.  ``statement`` is base64 of the JSON statement.
    """
    no_violation = violated.where(F.col("policy") == policy).select(F.lit(1).alias("one")).limit(1)
    ok = satisfied.where(F.col("policy") == policy).groupBy("purl").agg(F.max("component_id").alias("component_id")).withColumn("one", F.lit(1)).join(no_violation, "one", "left_anti").drop("one")
    d = digests.groupBy("component_id").agg(F.count("*").alias("n"), F.first("sha256").alias("sha256"))
    j = ok.join(d, "component_id", "left").where("coalesce(n, 0) <= 1")
    body = F.struct(
        F.lit("https://in-toto.io/Statement/v1").alias("_type"),
        F.array(F.struct(F.col("purl").alias("uri"), F.when(F.col("sha256").isNotNull(), F.create_map(F.lit("sha256"), F.col("sha256"))).alias("digest"))).alias("subject"),
        F.lit("https://slsa.dev/verification_summary/v1").alias("predicateType"),
        F.struct(F.col("purl").alias("resourceUri"), F.lit(policy).alias("policy"), F.lit("PASSED").alias("verificationResult")).alias("predicate"),
    )
    return j.select("purl", "component_id", "sha256", F.base64(F.encode(F.to_json(body), "utf-8")).alias("statement"))
