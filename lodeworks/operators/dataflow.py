"""Abstract interpretation of CI scripts: which values may reach which places.

State is a relation ``(node, location, value)`` with set semantics; values only ever accumulate (no strong updates), so
the fixpoint exists and is unique.  Control flow is an edge relation.  Statements are effect rows: a write of a literal, a
copy from another location, or a concatenation of a location with literals.  A round moves only the facts that are new
since the round before along the edges.

Shell scripts, where new code appears while values are resolved, are interpreted whole inside one task per script
(:func:`interpret_scripts`): data-dependent growth of the graph is no relational operation.
"""

from __future__ import annotations

import base64
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.graph import NoFixpoint
from lodeworks.session import cut

#: A concatenation of this length or more is not built (fixed value): it bounds the values a loop can make.
LONGEST_VALUE = 10_000
#: What stands for such a value, and for everything made from it.
TOO_LONG = f"(a value of {LONGEST_VALUE} characters or more)"


def normal_location(path):
    """``./a`` and ``a`` are one file."""
    return F.regexp_replace(path, r"^(?:\./)+", "")


def fixpoint(effects: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, location, value)``: all values that may be at a location after a node.

    ``effects(node, location, prefix, source, suffix)``: the node writes ``prefix || value(source) || suffix`` to the
    location; a null source writes the literal ``prefix``.  ``edges(src, dst)``: control flow.  A value that would be too
    long comes out as ``TOO_LONG``.
    """
    e = effects.select("node", normal_location(F.col("location")).alias("location"), F.coalesce("prefix", F.lit("")).alias("prefix"), normal_location(F.col("source")).alias("source"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    copies = e.where("source is not null")
    state = cut(e.where("source is null").select("node", "location", F.concat("prefix", "suffix").alias("value")).distinct())
    delta = state
    flow = edges.select(F.col("src").alias("node"), F.col("dst"))
    for _ in range(max_rounds):
        moved = delta.join(flow, "node").select(F.col("dst").alias("node"), "location", "value")
        # What arrives at a node, and what the node itself holds, is read by its effects.
        seen = moved.union(delta)
        written = (
            seen.withColumnRenamed("location", "source")
            .join(copies, ["node", "source"])
            .withColumn("built", F.concat("prefix", "value", "suffix"))
            .select("node", "location", F.when((F.col("value") == TOO_LONG) | (F.length("built") >= LONGEST_VALUE), TOO_LONG).otherwise(F.col("built")).alias("value"))
        )
        new = cut(moved.union(written).distinct().join(state, ["node", "location", "value"], "left_anti"))
        if new.isEmpty():
            return state
        state, delta = cut(state.union(new)), new
    raise NoFixpoint(f"values still grow after {max_rounds} rounds")


def values_in_scope(state: DataFrame, scopes: DataFrame, reads: DataFrame) -> DataFrame:
    """Values seen by a read: those of the nearest enclosing scope and all outside it.

    ``state(scope, location, value)``, ``scopes(scope, outer, distance)`` (the ancestor table, reflexive), ``reads(read, scope, location)``.
    """
    up = scopes.select("scope", F.col("outer").alias("at"), "distance")
    held = state.select(F.col("scope").alias("at"), "location", "value")
    return reads.join(up, "scope").join(held, ["at", "location"]).select("read", "value", "distance").groupBy("read", "value").agg(F.min("distance").alias("distance"))


def files_under(state: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of any file under a directory: every directory above a file is derived once, so the match is an equi-join."""
    parts = F.split("location", "/")
    dirs = state.select("node", "location", "value", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).otherwise(F.array().cast("array<string>"))).alias("directory"))
    return reads.join(dirs, ["node", "directory"]).select("read", "node", "location", "value")


def consistent_choices(bindings: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Bindings of one alternative in which every name has one value; conflicting alternatives are dropped."""
    bad = bindings.groupBy(key, name).agg(F.count_distinct(value).alias("_values")).where("_values > 1").select(key).distinct()
    return bindings.join(bad, key, "left_anti").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(name, value)))).alias("bindings"))


def secrets_reached(state: DataFrame) -> DataFrame:
    """``(node, secret)`` of values that come from a secret."""
    return state.where(F.col("value").startswith("secrets.")).select("node", F.expr("substr(value, 9)").alias("secret")).distinct()


def sequence_edges(steps: DataFrame, key: str, order: str) -> DataFrame:
    """``(src, dst)`` between neighbouring steps of each job."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order)
    return steps.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null")


def branch_edges(ifs: DataFrame) -> DataFrame:
    """``(src, dst)`` of conditionals ``(cond, then_node, else_node, exit_node)``: to both branches, or past a missing one."""
    to = F.array_distinct(F.array(F.col("then_node"), F.coalesce("else_node", "exit_node")))
    inner = ifs.select(F.col("cond").alias("src"), F.explode(to).alias("dst"))
    out = ifs.select(F.explode(F.array_compact(F.array("then_node", "else_node"))).alias("src"), F.col("exit_node").alias("dst"))
    return inner.union(out).where("dst is not null").distinct()


def action_effects(steps: DataFrame) -> DataFrame:
    """Effects of well-known CI actions: uploads write an artifact from a file, downloads a file from an artifact, set-up actions install a tool.

    ``steps(node, uses, name, path, version)``.
    """
    action = F.element_at(F.split(F.substring_index("uses", "@", 1), "/"), -1)
    artifact = F.concat(F.lit("artifact:"), "name")
    installed = F.concat(F.lit("installed:"), F.regexp_replace(action, "^setup-", ""))
    return (
        steps.withColumn("a", action)
        .select(
            "node",
            F.when(F.col("a") == "upload-artifact", artifact).when(F.col("a") == "download-artifact", F.col("path")).when(F.col("a").startswith("setup-"), installed).alias("location"),
            F.when(F.col("a").startswith("setup-"), F.coalesce("version", F.lit(""))).otherwise("").alias("prefix"),
            F.when(F.col("a") == "upload-artifact", F.col("path")).when(F.col("a") == "download-artifact", artifact).alias("source"),
            F.lit("").alias("suffix"),
        )
        .where("location is not null")
    )


# ---------------------------------------------------------------------------------------------------------------------
# Shell scripts


class Shell:
    """Interprets a small part of the shell over sets of values: assignments, ``echo``, ``base64``, redirections, pipes, ``&&``, ``||``, ``;``, ``if`` and calls."""

    _ASSIGN = re.compile(r"^(?:export\s+)?([A-Za-z_]\w*)=(.*)$", re.S)
    _KEYWORD = re.compile(r"^(?:(?:if|elif|while|until|then|else|do|!)(?:\s+|$))+|^(?:fi|done|esac)$")
    _VAR = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")

    def __init__(self, env: dict[str, set[str]] | None = None):
        self.env: dict[str, set[str]] = {k: set(v) for k, v in (env or {}).items()}
        self.files: dict[str, set[str]] = {}
        self.commands: list[str] = []
        #: Why the result is not everything the script may do.
        self.notes: set[str] = set()

    def expand(self, word: str) -> set[str]:
        """All texts a word may stand for; an unknown variable leaves the word as it is."""
        m = self._VAR.search(word)
        if not m:
            return {word}
        name = m.group(1) or m.group(2)
        out = set()
        for v in self.env.get(name, {f"\0{name}\0"}):
            for rest in self.expand(word[m.end() :]):
                x = word[: m.start()] + v + rest
                if len(x) < LONGEST_VALUE:
                    out.add(x)
                else:
                    self.notes.add(TOO_LONG)
        return out

    @staticmethod
    def split(line: str, seps: tuple[str, ...]) -> list[str]:
        """Parts of a line at separators outside quotes and substitutions."""
        parts, cur, quote, depth, i = [], "", "", 0, 0
        while i < len(line):
            c = line[i]
            if quote != "'" and line.startswith("$(", i) or depth and c == "(":
                depth += 1
            elif depth and c == ")":
                depth -= 1
            sep = next((s for s in seps if not quote and not depth and line.startswith(s, i)), None)
            if sep:
                parts.append(cur)
                cur, i = "", i + len(sep)
                continue
            if c in "\"'" and not depth:
                quote = "" if quote == c else quote or c
            step = 2 if line.startswith("$(", i) and quote != "'" else 1
            cur += line[i : i + step]
            i += step
        return [p.strip() for p in [*parts, cur] if p.strip()]

    def run(self, text: str) -> None:
        text = re.sub(r"\\\n", " ", text)
        for line in text.split("\n"):
            line = re.sub(r"(^|\s)#.*$", "", line).strip()
            for command in self.split(line, ("&&", "||", ";")):
                if command := self._KEYWORD.sub("", command).strip():
                    self.pipeline(command)

    def pipeline(self, command: str) -> None:
        stdin: set[str] | None = None
        for part in self.split(command, ("|&", "|")):
            stdin = self.simple(part, stdin)

    def simple(self, command: str, stdin: set[str] | None) -> set[str]:
        if (m := self._ASSIGN.match(command)) and not re.search(r"\s", re.sub(r"\"[^\"]*\"|'[^']*'|\$\([^)]*\)", "", m.group(2))):
            self.env.setdefault(m.group(1), set()).update(self.value(m.group(2)))
            return set()
        target = re.search(r"(?:^|\s)>{1,2}\s*(\S+)\s*$", command)
        body = command[: target.start()] if target else command
        try:
            words = shlex.split(body)
        except ValueError:
            words = body.split()
        if not words:
            return set()
        self.commands.append(" ".join(sorted(self.expand(" ".join(words)))[:1]))
        out: set[str] = set()
        if words[0] == "echo":
            out = self.expand(" ".join(w for w in words[1:] if w not in ("-n", "-e")))
        elif words[0] == "base64":
            out = {d for v in stdin or () if (d := self.decode(v)) is not None} if {"-d", "--decode", "-D"} & set(words) else set()
        elif words[0] == "cat" and len(words) == 2:
            out = set(self.files.get(words[1].removeprefix("./"), ()))
        elif words[0] in ("bash", "sh") and len(words) == 1 and stdin:
            for script in sorted(stdin):
                self.run(script)
        elif words[0] in ("bash", "sh", "source", ".") and len(words) == 2:
            for script in sorted(self.files.get(words[1].removeprefix("./"), ())):
                self.run(script)
        if target:
            self.files.setdefault(target.group(1).strip("\"'").removeprefix("./"), set()).update(out)
            return set()
        return out

    def value(self, text: str) -> set[str]:
        text = text.strip()
        if m := re.fullmatch(r"\"?(?:\$\((.*)\)|`(.*)`)\"?", text, re.S):
            stdin: set[str] | None = None
            for part in self.split(m.group(1) or m.group(2), ("|",)):
                stdin = self.simple(part, stdin)
            return stdin or set()
        if text[:1] == "'" == text[-1:]:
            return {text[1:-1]}
        return self.expand(text.strip('"'))

    @staticmethod
    def decode(text: str) -> str | None:
        try:
            return base64.b64decode(text.strip() + "=" * (-len(text.strip()) % 4)).decode()
        except ValueError:
            return None


def interpret_scripts(df: DataFrame, id_col: str, script: str) -> DataFrame:
    """``(id, kind, name, value)``: variables and files with every value they may hold, and the commands run, in order (``name`` is the position).

    A script that is not followed to its end has rows of the kind ``incomplete`` that say why.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["s"], strict=True):
                sh = Shell()
                try:
                    sh.run(text or "")
                except RecursionError:  # what is known so far stands, and the result says so
                    sh.notes.add("the script calls itself")
                rows += [(i, "variable", k, v) for k, vs in sorted(sh.env.items()) for v in sorted(vs) if "\0" not in v]
                rows += [(i, "file", k, v) for k, vs in sorted(sh.files.items()) for v in sorted(vs) if "\0" not in v]
                rows += [(i, "incomplete", n, None) for n in sorted(sh.notes)]
                rows += [(i, "command", str(n), c.replace("\0", "$")) for n, c in enumerate(sh.commands)]
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "value"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(script).cast("string").alias("s")).mapInPandas(run, "id long, kind string, name string, value string")
