"""Problem 5: deeply nested records become flat related tables with parent-child links.

Method: shared inlining.  The schema graph has one node per element type (key name) and an edge for each key seen under
another.  Elements that are repeated, shared (reached from several parents) or recursive become tables of their own;
every other descendant is a singleton and is inlined into its nearest ancestor that is a table.  Each row carries its own
path as key and the path of its parent row as foreign key.

The graph is analysed before any row is made: :func:`infer_graph` reads it from all documents of a text column
(:func:`schema_graph` from the type of a typed one).  What the public formats declare below is added to it, so an element
that a format repeats is repeated even where these documents happen to hold it once.  Then one pass over each document fills
all tables (or only those asked for); rows are small and nothing but the edges of the graph is shuffled.  Typed columns are
taken apart by generated ``posexplode`` steps in the JVM.

Defined results: a document that is null, empty or not one complete JSON object gives no rows (:func:`unreadable` lists
them); any depth is read; a lone object under a repeated key is an array of one; null elements keep their position and give
no row; numbers stay as written; texts are decoded from base64 (either alphabet, any line breaks, padded or not) when they
are not JSON themselves; the last of equal keys holds; documents that come again give their rows again under their own id.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = ""


class Edge(NamedTuple):
    """``child`` occurs under ``parent``; ``repeated`` if it may be an array."""

    parent: str
    child: str
    repeated: bool


class Inlining(NamedTuple):
    """Result of the analysis: element types with a table of their own, and those of them that are arrays."""

    tables: frozenset[str]
    repeated: frozenset[str]


def shared_inlining(edges: Iterable[Edge]) -> Inlining:
    """Which element types get a table: repeated ones, those with several parents, and those on a cycle."""
    parents, children, repeated = defaultdict(set), defaultdict(set), set()
    for e in edges:
        parents[e.child].add(e.parent)
        children[e.parent].add(e.child)
        if e.repeated:
            repeated.add(e.child)
    shared = {c for c, p in parents.items() if len(p) > 1}
    recursive = set()
    for start in children:
        stack, seen = list(children[start]), set()
        while stack:
            x = stack.pop()
            if x == start:
                recursive.add(start)
                break
            if x not in seen:
                seen.add(x)
                stack.extend(children.get(x, ()))
    return Inlining(frozenset(repeated | shared | recursive), frozenset(repeated))


def _edges(spec: dict[str, str]) -> list[Edge]:
    return [Edge(p, c.rstrip("*"), c.endswith("*")) for p, cs in spec.items() for c in cs.split()]


#: Elements of bills of materials; ``*`` marks arrays.
BOM = _edges({
    ROOT: "metadata components* services* dependencies* externalReferences* compositions* vulnerabilities* properties*",
    "metadata": "tools* authors* component licenses* properties*",
    "tools": "components* services* hashes* externalReferences*",
    "component": "components* hashes* externalReferences* licenses* properties* pedigree evidence",
    "components": "components* hashes* externalReferences* licenses* properties* pedigree evidence",
    "services": "services* externalReferences* licenses* properties*",
    "externalReferences": "hashes*",
    "pedigree": "ancestors* descendants* variants* commits* patches*",
    "ancestors": "components* hashes* externalReferences*",
    "dependencies": "dependsOn* provides*",
})
#: Elements of provenance statements, both predicate layouts.
STATEMENT = _edges({
    ROOT: "subject* predicate",
    "subject": "digest",
    "predicate": "builder invocation materials* metadata buildDefinition runDetails",
    "invocation": "configSource parameters environment",
    "configSource": "digest",
    "materials": "digest",
    "buildDefinition": "externalParameters internalParameters resolvedDependencies*",
    "externalParameters": "workflow",
    "resolvedDependencies": "digest",
    "runDetails": "builder metadata byproducts*",
    "builder": "builderDependencies*",
    "builderDependencies": "digest",
    "byproducts": "digest",
})


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


class Number(str):
    """A number as it is written."""


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_float=Number, parse_int=Number, strict=False)
_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(s: str) -> object:
    """What the decoder gives, for documents nested deeper than it can go: one loop, no recursion."""
    done: list = []
    open_: list[list | dict] = []
    keys: list[str] = []
    at = _BLANK.match(s).end()

    def char() -> str:
        return s[at : at + 1]

    def skip(n: int = 0) -> None:
        nonlocal at
        at = _BLANK.match(s, at + n).end()

    def key() -> None:
        nonlocal at
        if char() != '"':
            raise ValueError("a key is expected")
        k, at = json.decoder.scanstring(s, at + 1, False)
        skip()
        if char() != ":":
            raise ValueError("a colon is expected")
        skip(1)
        keys.append(k)

    while True:
        c = char()
        if c == "{" or c == "[":
            open_.append({} if c == "{" else [])
            skip(1)
            if char() != ("}" if c == "{" else "]"):
                if c == "{":
                    key()
                continue
            value: object = open_.pop()
            skip(1)
        elif c == '"':
            value, at = json.decoder.scanstring(s, at + 1, False)
            skip()
        elif m := _ATOM.match(s, at):
            value = _WORDS[m[0]] if m[0] in _WORDS else Number(m[0])
            at = m.end()
            skip()
        else:
            raise ValueError("a value is expected")
        while open_:  # the value goes into its holder, which may be complete with it
            holder = open_[-1]
            if isinstance(holder, dict):
                holder[keys.pop()] = value
            else:
                holder.append(value)
            c = char()
            if c == ",":
                skip(1)
                if isinstance(holder, dict):
                    key()
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("a comma or an end is expected")
            value = open_.pop()
            skip(1)
        else:
            done.append(value)
            break
    if at != len(s):
        raise ValueError("something follows the document")
    return done[0]


_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def document(text: str | None) -> dict | None:
    """The JSON object a text holds, itself or in base64; None if it is none or not complete."""
    if not text:
        return None
    s = text.strip().lstrip("﻿")
    if not s:
        return None
    if s[0] not in "{[":
        s = re.sub(r"\s+", "", s).replace("-", "+").replace("_", "/").rstrip("=")
        if _NOT_BASE64.search(s):
            return None
        try:
            s = base64.b64decode(s + "=" * (-len(s) % 4)).decode("utf-8").strip()
        except (binascii.Error, ValueError):
            return None
    try:
        try:
            out = _DECODER.decode(s)
        except RecursionError:
            out = _deep(s)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


class Row(NamedTuple):
    table: str
    path: str
    parent_row: str
    parent_path: str
    pos: int
    columns: dict[str, str]


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _is_single(key: str, value: dict, plan: Inlining) -> bool:
    """An object under a repeated key that is a holder of further elements, not a lone element of the array."""
    return bool(value) and all(k in plan.repeated and isinstance(v, (list, dict)) for k, v in value.items())


def rows_of(doc: dict, plan: Inlining, only: frozenset[str] | None = None) -> Iterator[Row]:
    """All rows of a document, parents before children.  A plan's table named ``digest`` is a map: one row with its entries."""
    stack: list[tuple[str, dict, str, str, str, int]] = [(ROOT, doc, "", "", "", 0)]
    while stack:
        table, obj, path, parent_row, parent_path, pos = stack.pop()
        columns: dict[str, str] = {}
        later: list[tuple[str, dict, str, str, str, int]] = []
        inner: list[tuple[str, dict, str]] = [("", obj, path)]
        while inner:
            prefix, o, at = inner.pop()
            for k, v in o.items():
                here = f"{at}.{k}" if at else k
                if isinstance(v, dict) and k in plan.repeated and not _is_single(k, v, plan):
                    v = [v]
                if isinstance(v, list):
                    for i, x in enumerate(v):
                        if isinstance(x, dict):
                            later.append((k, x, f"{here}[{i}]", path, at, i))
                        elif x is not None:
                            later.append((k, {"value": x}, f"{here}[{i}]", path, at, i))
                elif isinstance(v, dict):
                    if k in plan.tables and k not in plan.repeated:
                        later.append((k, v, here, path, at, 0))
                    else:
                        inner.append((f"{prefix}{k}.", v, here))
                elif v is not None:
                    columns[prefix + k] = _text(v)
        if only is None or table in only:
            yield Row(table, path, parent_row, parent_path, pos, columns)
        stack.extend(reversed(later))


#: Characters of rows after which a batch is handed on.
FLUSH_CHARS = 16 << 20
SCHEMA = "rec_id long, table string, path string, parent_row string, parent_path string, pos int, columns map<string,string>"


def relations(df: DataFrame, id_col: str, text_col: str, edges: Iterable[Edge], only: set[str] | None = None) -> DataFrame:
    """Rows of all tables of a JSON text column: ``(rec_id, table, path, parent_row, parent_path, pos, columns)``.

    ``path`` is a row's key within its document, ``parent_row`` the foreign key to the row of the table it hangs on,
    ``parent_path`` the object that holds it (inlined into ``parent_row`` or that row itself).
    """
    plan, wanted = shared_inlining(edges), frozenset(only) if only is not None else None
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
    names = ["rec_id", "table", "path", "parent_row", "parent_path", "pos", "columns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            cols: list[list] = [[] for _ in types]
            size = 0
            for rec, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = document(text)
                if doc is None:
                    continue
                for r in rows_of(doc, plan, wanted):
                    for c, v in zip(cols, (rec, r.table, r.path, r.parent_row, r.parent_path, r.pos, list(r.columns.items())), strict=True):
                        c.append(v)
                    size += len(r.path) + len(r.parent_path) + sum(map(len, r.columns.values()))
                    if len(cols[0]) > 20_000 or size > FLUSH_CHARS:  # large documents must not become one huge batch of rows
                        yield flush(cols)
                        cols, size = [[] for _ in types], 0
            yield flush(cols)

    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(run, SCHEMA)


def infer_graph(df: DataFrame, text_col: str, most: int = 10_000) -> list[Edge]:
    """Edges of the schema graph of all documents; refused above ``most``, which only maps written as objects can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, str, bool]] = set()
            for text in b.column(0).to_pylist():
                stack = [(ROOT, d)] if (d := document(text)) else []
                while stack:
                    parent, o = stack.pop()
                    for k, v in o.items():
                        if isinstance(v, dict):
                            seen.add((parent, k, False))
                            stack.append((k, v))
                        elif isinstance(v, list):
                            seen.add((parent, k, True))
                            stack.extend((k, x) for x in v if isinstance(x, dict))
            a, c, r = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string()), pa.array(r, pa.bool_())], names=["parent", "child", "repeated"])

    rows = df.select(F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(run, "parent string, child string, repeated boolean").groupBy("parent", "child").agg(F.max("repeated").alias("repeated")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    return [Edge(r.parent, r.child, r.repeated) for r in rows]


def graph_of(df: DataFrame, text_col: str, declared: Iterable[Edge] = ()) -> list[Edge]:
    """The graph of all documents together with what their format declares."""
    merged: dict[tuple[str, str], bool] = {}
    for e in (*infer_graph(df, text_col), *declared):
        merged[e.parent, e.child] = merged.get((e.parent, e.child), False) or e.repeated
    return [Edge(p, c, r) for (p, c), r in sorted(merged.items())]


def unreadable(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, reason)`` of documents without rows: ``null``, ``empty``, or ``broken`` (not one complete JSON object)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [(i, "null" if t is None else "broken" if t.strip() else "empty") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if document(t) is None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in bad], pa.int64()), pa.array([r for _, r in bad], pa.string())], names=["rec_id", "reason"])

    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "rec_id long, reason string")


def schema_graph(kind: T.DataType, name: str = ROOT) -> list[Edge]:
    """Edges of a column's type."""
    out: list[Edge] = []
    stack = [(name, kind)]
    while stack:
        at, k = stack.pop()
        for f in k.fields if isinstance(k, T.StructType) else ():
            child, repeated = f.dataType, False
            while isinstance(child, T.ArrayType):
                child, repeated = child.elementType, True
            if repeated or isinstance(child, T.StructType):
                out.append(Edge(at, f.name, repeated))
            stack.append((f.name, child))
    return out


def typed_table(df: DataFrame, id_col: str, columns: list[str], table: str) -> DataFrame:
    """The table of one element type of typed nested columns: links as in :func:`relations`, then its own and inlined fields.

    Every place where the type's graph has the element gives a chain of ``posexplode`` steps; fields are texts.
    """
    root = T.StructType([df.schema[c] for c in columns])
    plan = shared_inlining(schema_graph(root))
    out: list[DataFrame] = []

    def inlined(at: Column, k: T.StructType, prefix: str) -> list[Column]:
        cols: list[Column] = []
        for f in k.fields:
            if isinstance(f.dataType, T.StructType):
                if f.name not in plan.tables:
                    cols += inlined(at[f.name], f.dataType, f"{prefix}{f.name}.")
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                cols.append(at[f.name].cast("string").alias(f"c.{prefix}{f.name}"))
        return cols

    def walk(rows: DataFrame, at: Column, k: T.StructType, holder: Column, row: Column) -> None:
        """``at`` is the object in ``rows``, ``holder`` its path, ``row`` the path of the table row it belongs to."""
        for f in k.fields:
            here = F.when(holder == "", F.lit(f.name)).otherwise(F.concat(holder, F.lit(f".{f.name}")))
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                child = f.dataType.elementType
                x = rows.select("rec_id", here.alias("_here"), holder.alias("_holder"), row.alias("_row"), F.posexplode(at[f.name]).alias("_pos", "_x")).where("_x is not null")
                path = F.concat("_here", F.lit("["), "_pos", F.lit("]"))
            elif isinstance(f.dataType, T.StructType):
                child = f.dataType
                x = rows.select("rec_id", here.alias("_here"), holder.alias("_holder"), row.alias("_row"), F.lit(0).alias("_pos"), at[f.name].alias("_x")).where("_x is not null")
                path = F.col("_here")
            else:
                continue
            own = f.name in plan.tables
            if f.name == table:
                out.append(x.select("rec_id", path.alias("path"), F.col("_row").alias("parent_row"), F.col("_holder").alias("parent_path"), F.col("_pos").alias("pos"), *inlined(F.col("_x"), child, "")))
            walk(x.withColumn("_path", path), F.col("_x"), child, F.col("_path"), F.col("_path") if own else F.col("_row"))

    start = df.select(F.col(id_col).cast("long").alias("rec_id"), F.struct(*columns).alias("_x"), F.lit("").alias("_path"))
    walk(start, F.col("_x"), root, F.col("_path"), F.col("_path"))
    if not out:
        raise ValueError(f"{table} is no element of {', '.join(columns)}")
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o, allowMissingColumns=True)
    return both.toDF(*[c.removeprefix("c.") + ("_" if c.startswith("c.") and c.removeprefix("c.") in ("rec_id", "path", "parent_row", "parent_path", "pos") else "") for c in both.columns])


def table(rel: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One table of :func:`relations` with the given columns; a column that clashes with a link gets a trailing underscore."""
    links = ["rec_id", "path", "parent_row", "parent_path", "pos"]
    return rel.where(F.col("table") == name).select(*links, *[F.col("columns")[c].alias(c.replace(".", "_") + ("_" if c in links else "")) for c in columns])


def leaves(rel: DataFrame, src: str, fields: dict[str, str], maps: tuple[str, ...] = ()) -> DataFrame:
    """``(src, rec_id, parent_path, child_kind, child_pos, child_value)``: one row per non-null leaf.

    ``fields`` names the leaf of each table; tables in ``maps`` give one row per entry.
    """
    named = rel.where(F.col("table").isin(list(fields))).select(
        "rec_id", "parent_path", F.col("table").alias("child_kind"), F.col("pos").cast("long").alias("child_pos"),
        F.coalesce(*[F.when(F.col("table") == t, F.col("columns")[c]) for t, c in fields.items()]).alias("child_value"),
    ) if fields else None
    out = named
    if maps:
        m = rel.where(F.col("table").isin(list(maps))).select("rec_id", "parent_path", "table", F.explode("columns").alias("k", "child_value"))
        m = m.select("rec_id", "parent_path", F.concat("table", F.lit("."), "k").alias("child_kind"), F.lit(0).cast("long").alias("child_pos"), "child_value")
        out = m if out is None else out.unionByName(m)
    return out.where("child_value is not null").select(F.lit(src).alias("src"), "*")
