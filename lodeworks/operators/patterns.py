"""Source-pattern rules, expectations on documents, version specifiers and command lines."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.versions import version_key


class PatternRule(NamedTuple):
    """A rule over source lines; rules of disabled rulesets or ids are reported apart and never fail a package."""

    rule: str
    ruleset: str
    pattern: str


#: Lexical rules for suspicious source text.
DEFAULT_RULES = (
    PatternRule("decode-and-execute", "obfuscation", r"\b(?:exec|eval)\s*\(.*\b(?:b64decode|unhexlify|fromhex|decompress|loads)\s*\("),
    PatternRule("hex-escape-run", "obfuscation", r"(?:\\x[0-9a-fA-F]{2}){8,}"),
    PatternRule("char-code-join", "obfuscation", r"join\s*\(\s*(?:map\s*\(\s*chr\b|\[?\s*chr\s*\()"),
    PatternRule("dynamic-import", "obfuscation", r"__import__\s*\(\s*+(?![\"'])"),
    PatternRule("environment-upload", "exfiltration", r"\b(?:post|put|urlopen|request)\s*\(.*\bos\.environ\b"),
    PatternRule("virtual-machine-probe", "anti_analysis", r"(?i)\b(?:vmware|virtualbox|qemu|sandboxie)\b"),
    PatternRule("debugger-probe", "anti_analysis", r"\bsys\.gettrace\s*\(\s*\)"),
)


def pattern_hits(lines: DataFrame, key: str, path: str, no: str, text: str, rules: Sequence[PatternRule] = DEFAULT_RULES, disabled: Sequence[str] = ()) -> DataFrame:
    """``(key, rule, enabled, detections)``: where each rule matches.  ``disabled`` names rules or rulesets."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(r.pattern), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.rule not in disabled and r.ruleset not in disabled).alias("enabled"))) for r in rules]))
    hits = lines.select(key, path, no, F.explode(found).alias("h"))
    return hits.groupBy(key, "h.rule", "h.enabled").agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(no).alias("line")))).alias("detections"))


def suspicious(hits: DataFrame, packages: DataFrame, key: str) -> DataFrame:
    """``(key, result)``: FAIL with a hit of any enabled rule."""
    bad = hits.where("enabled").select(key).distinct().withColumn("hit", F.lit(True))
    return packages.select(key).distinct().join(bad, key, "left").select(key, F.when(F.col("hit"), "FAIL").otherwise("PASS").alias("result"))


def expectation(v: Column, required: Mapping[str, str | None]) -> Column:
    """Does a VARIANT document meet an expectation: each path must be there and match its full-string pattern (None: any value)."""
    ok = v.isNotNull()
    for path, pattern in required.items():
        x = F.try_variant_get(v, path, "string")
        ok = ok & x.isNotNull() & (x.rlike(rf"\A(?:{pattern})\z") if pattern is not None else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def satisfies(version: Column, specifier: str) -> Column:
    """Does a version satisfy comma-separated clauses such as ``>=1.2,<2,!=1.5,~=1.4``?  Unreadable versions do not."""
    k, ok = version_key(version), F.lit(True)
    for clause in filter(None, (c.strip() for c in specifier.split(","))):
        m = re.fullmatch(r"(~=|===?|!=|<=|>=|<|>)\s*([^\s]+)", clause)
        if not m:
            raise ValueError(f"{clause!r} is no clause")
        op, v = m.groups()
        if v.endswith(".*"):
            inside = version.rlike(rf"^\s*v?{re.escape(v[:-2])}(?:[.]|$|[a-z+-])")
            ok = ok & (inside if op in ("==", "===") else ~inside)
            continue
        other = version_key(F.lit(v))
        if op == "~=":
            head = ".".join(re.split(r"[.]", v)[:-1])
            ok = ok & (k >= other) & version.rlike(rf"^\s*v?{re.escape(head)}(?:[.]|$|[a-z+-])")
        else:
            ok = ok & {"==": k == other, "===": k == other, "!=": k != other, "<=": k <= other, ">=": k >= other, "<": k < other, ">": k > other}[op]
    return k.isNotNull() & ok


def lowest_satisfying(df: DataFrame, key: str, version: str, specifier: str) -> DataFrame:
    """The lowest version of each key that satisfies a specifier."""
    return df.where(satisfies(F.col(version), specifier)).groupBy(key).agg(F.min_by(version, version_key(F.col(version))).alias(version))


#: Options that take a value, by tool.
VALUE_OPTIONS = {
    "mvn": ("-f", "--file", "-P", "--activate-profiles", "-s", "--settings", "-gs", "-T", "--threads", "-pl", "--projects", "-rf", "--resume-from", "-l", "--log-file", "-b", "--builder"),
    "gradle": ("-b", "--build-file", "-c", "--settings-file", "-g", "--gradle-user-home", "-I", "--init-script", "-p", "--project-dir", "-x", "--exclude-task", "--console", "--max-workers"),
}


def parse_command(text: str) -> dict | None:
    """Program, goals, options and properties of one Maven or Gradle command line; None for anything else."""
    try:
        words = shlex.split(text)
    except ValueError:
        return None
    if not words:
        return None
    program = words[0].rsplit("/", 1)[-1]
    tool = {"mvn": "mvn", "mvnw": "mvn", "mvnd": "mvn", "gradle": "gradle", "gradlew": "gradle"}.get(program)
    if tool is None:
        return None
    goals, options, props, i = [], {}, {}, 1
    while i < len(words):
        w = words[i]
        prop = re.match(r"^-[DP]([^=]+?)(?:=(.*))?$", w, re.S) if w.startswith("-D") or (tool == "gradle" and w.startswith("-P") and len(w) > 2) else None
        if w == "-D" and i + 1 < len(words):
            k, _, v = words[i + 1].partition("=")
            props[k] = v or "true"
            i += 1
        elif prop:
            props[prop.group(1)] = prop.group(2) if prop.group(2) is not None else "true"
        elif w.startswith("--") and "=" in w:
            k, _, v = w.partition("=")
            options[k] = v
        elif w in VALUE_OPTIONS[tool] and i + 1 < len(words):
            options[w] = words[i + 1]
            i += 1
        elif w.startswith("-"):
            options[w] = "true"
        else:
            goals.append(w)
        i += 1
    return {"tool": tool, "program": words[0], "goals": goals, "options": options, "properties": props}


COMMAND_SCHEMA = "tool string, program string, goals array<string>, options map<string,string>, properties map<string,string>"


def parse_commands(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, tool, program, goals, options, properties)`` of command lines; null where it is neither tool's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"], strict=True):
                p = parse_command(t) if t else None
                rows.append((i, *(p.values() if p else (None,) * 5)))
            yield pd.DataFrame(rows, columns=["id", "tool", "program", "goals", "options", "properties"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInPandas(run, f"id long, {COMMAND_SCHEMA}")


def patched_command(tool: Column, goals: Column, options: Column, properties: Column) -> Column:
    """The command line of parsed parts, options and properties in the order of their names."""
    def pairs(m: Column, sep: str, prefix: str) -> Column:
        return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.when(e["value"] == "true", F.concat(F.lit(prefix), e["key"])).otherwise(F.concat(F.lit(prefix), e["key"], F.lit(sep), e["value"])))

    return F.array_join(F.concat(F.array(tool), goals, pairs(options, " ", ""), pairs(properties, "=", "-D")), " ")
