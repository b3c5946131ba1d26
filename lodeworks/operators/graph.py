"""Recursive relations: closure, reachability, selection closure, topological levels and the assurance lattice."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import cut


class NoFixpoint(RuntimeError):
    """A loop did not settle within its round limit."""


def transitive_closure(edges: DataFrame, src: str = "parent", dst: str = "child", max_rounds: int = 64) -> DataFrame:
    """All pairs connected by at least one edge, with set semantics; cycles are allowed.

    Paths are doubled in every round (delta joined with everything known), so the rounds grow with the logarithm of the
    depth.  Each round is written to the checkpoint folder, which bounds the plan and survives lost executors.
    """
    known = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    delta = known
    for _ in range(max_rounds):
        # Renamed by projection: both sides may be the same checkpoint.
        left = delta.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        right = known.select("a", F.col("b").alias("m")).join(delta.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        new = cut(left.union(right).distinct().join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known.select(F.col("a").alias(src), F.col("b").alias(dst))
        known, delta = cut(known.union(new)), new
    raise NoFixpoint(f"closure is not complete after {max_rounds} rounds")


def reachable(edges: DataFrame, start: DataFrame, src: str = "parent", dst: str = "child", reflexive: bool = True, max_rounds: int = 1000) -> DataFrame:
    """``(node, depth)`` of all nodes that the start nodes (one column) reach, at their least depth."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    seen = cut(start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, max_rounds + 1):
        new = cut(front.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen if reflexive else seen.where("depth > 0")
        seen, front = cut(seen.union(new)), new
    raise NoFixpoint(f"more than {max_rounds} levels")


def topological_levels(edges: DataFrame, src: str = "parent", dst: str = "child", max_rounds: int = 1000) -> DataFrame:
    """``(node, level)``: the longest path from a root; a cycle raises :class:`NoFixpoint`."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    done = cut(nodes.join(e, F.col("node") == F.col("b"), "left_anti").withColumn("level", F.lit(0)))
    rest = cut(nodes.join(done, "node", "left_anti"))
    for level in range(1, max_rounds + 1):
        if rest.isEmpty():
            return done
        blocked = e.join(rest, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        free = cut(rest.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise NoFixpoint("the graph has a cycle")
        done, rest = cut(done.union(free)), cut(rest.join(free, "node", "left_anti"))
    raise NoFixpoint(f"more than {max_rounds} levels")


def glob_to_regex(pattern: str) -> str:
    """Shell pattern as an anchored regular expression."""
    parts = {"*": ".*", "?": "."}
    return "^(?:" + "".join(parts.get(c, re.escape(c)) for c in pattern) + ")$"


def selection_closure(edges: DataFrame, nodes: DataFrame, include: Iterable[str], exclude: Iterable[str], src: str = "parent", dst: str = "child") -> DataFrame:
    """Nodes that match ``include`` with all their ancestors, without those that match ``exclude`` and all their descendants.

    ``parent`` must run before ``child``; patterns are shell patterns.
    """
    name = nodes.columns[0]

    def matching(patterns: Iterable[str]) -> DataFrame:
        cond = F.lit(False)
        for p in patterns:
            cond = cond | F.col(name).rlike(glob_to_regex(p))
        return nodes.where(cond).select(F.col(name).alias("node"))

    wanted = reachable(edges, matching(include), dst, src).select("node")
    unwanted = reachable(edges, matching(exclude), src, dst).select("node")
    return wanted.join(unwanted, "node", "left_anti").distinct()


#: Own level and the least level it asks of every dependency (fixed values).
REQUIRED_OF_DEPENDENCIES = {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
#: Checks that each level adds to the one below (fixed values).
LEVEL_CHECKS = {
    1: ("mcn_version_control_system_1", "mcn_build_service_1", "mcn_build_script_1"),
    2: ("mcn_build_as_code_1",),
    3: ("mcn_trusted_builder_level_three_1", "mcn_provenance_level_three_1"),
    4: ("mcn_provenance_expectation_1",),
}


def own_levels(components: DataFrame, check_result: DataFrame) -> DataFrame:
    """``(id, own_level)``: the highest level all of whose checks, and those of all lower levels, passed."""
    passed = check_result.where("passed = 1").groupBy("component_id").agg(F.collect_set("check_id").alias("checks"))
    have = components.select("id").join(passed, F.col("id") == F.col("component_id"), "left")
    level, need = F.lit(0), []
    for n in sorted(LEVEL_CHECKS):
        need.extend(LEVEL_CHECKS[n])
        level = F.when(F.forall(F.array(*map(F.lit, need)), lambda c: F.array_contains(F.coalesce("checks", F.array().cast("array<string>")), c)), n).otherwise(level)
    return have.select("id", level.alias("own_level"))


def aggregate_levels(components: DataFrame, dependency: DataFrame, check_result: DataFrame) -> DataFrame:
    """``(id, own_level, level)`` in closed form: the highest level up to a component's own that its weakest dependency allows."""
    own = own_levels(components, check_result)
    closure = transitive_closure(dependency)
    weakest = closure.join(own.select(F.col("id").alias("child"), F.col("own_level").alias("l")), "child").groupBy("parent").agg(F.min("l").alias("weakest"))
    level = F.greatest(*[F.when((F.col("own_level") >= n) & (F.coalesce("weakest", F.lit(9)) >= need), n).otherwise(0) for n, need in REQUIRED_OF_DEPENDENCIES.items()])
    return own.join(weakest, F.col("id") == F.col("parent"), "left").select("id", "own_level", level.alias("level"))


def levels_met(levels: DataFrame) -> DataFrame:
    """``(id, level)`` for every level up to the one reached."""
    return levels.select("id", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))


def tree_paths(edges: DataFrame, src: str = "parent", dst: str = "child", sep: str = "/", max_rounds: int = 1000) -> DataFrame:
    """``(node, path)``: every way from a root to a node, the nested form of a forest or acyclic graph as rows."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    roots = e.select(F.col("a").alias("node")).distinct().join(e.select(F.col("b").alias("node")), "node", "left_anti")
    front = cut(roots.select("node", F.col("node").cast("string").alias("path")))
    parts = [front]
    for _ in range(max_rounds):
        front = cut(front.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.lit(sep), F.col("b").cast("string")).alias("path")))
        if front.isEmpty():
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out
        parts.append(front)
    raise NoFixpoint(f"more than {max_rounds} levels: the graph may have a cycle")
