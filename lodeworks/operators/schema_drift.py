"""Problem 4: files whose fields are added, renamed, removed or change type are read into one table, and every change is reported.

Method: a column lifespan catalogue.  The keys of all records are exploded to (producer, file, field, type) and reduced to
one small row per file, field and type.  ``lag`` over the files of each (producer, field, type) cuts its islands; where
islands start and end is the log of changes: a field none of whose types was there before is added, one none of whose types
goes on is removed, anything else is a change of type.  Ends and starts that carry the same values for the same records
become renames; casts are generated from an alias table that is derived from those renames.

Everything runs in the JVM (VARIANT).  The lines are parsed once; what is compared later (file, field, type, hashes of record
key and value) is stored as a narrow table.  The catalogue is pre-aggregated before the shuffle, so a producer with a third
of all rows costs no skew.  The rename check compares only records of fields that ended or started.

Defined results
---------------
* a line that is null, empty, not a complete JSON object or followed by anything is broken and ignored (its file exists);
* null values count as absent; key names are case-sensitive;
* repeated lines count once; a record whose key comes with two values in one file agrees if one of them agrees;
* a record without the key field takes part in everything but the rename check;
* several fields with the same values that are renamed in one file are matched one to one, best share first, then by name;
* a producer with one file has no changes; an empty table gives empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.session import cut, stored

#: Share of the records found in both files whose value must stand under the new key.
SAME_VALUES = 0.9
#: Bound of what the alias table may hold: distinct field names and renames, whatever the number of files.
MOST_ALIASES = 100_000


def wrapped(line: Column) -> Column:
    """VARIANT of the array that holds what a line holds, null if that cannot be one JSON object.

    ``try_parse_json`` overlooks what follows a document; wrapped into an array, anything that follows breaks it or
    becomes a second element.
    """
    text = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))


def parsed(lines: DataFrame, producer: str, seq: str, line: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(producer, seq, *keep, v)`` of the lines that are not broken."""
    # A filter on what is parsed would be pushed below the parsing and parse again; it cannot pass the explode.
    w = lines.select(F.col(producer).alias("producer"), F.col(seq).cast("long").alias("seq"), *keep, F.explode(F.array(wrapped(F.col(line)))).alias("w"))
    v = w.where("w is not null and try_variant_get(w, '$[1]', 'variant') is null")
    return v.select("producer", "seq", *keep, F.expr("variant_get(w, '$[0]', 'variant')").alias("v"))


def _kind(text: Column) -> Column:
    """JSON type by the first character of a value's text; null for JSON null."""
    c = F.substring(text, 1, 1)
    return F.when(c == "n", None).when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "[", "array").when(c == "{", "object").otherwise("number")


def entries(lines: DataFrame, producer: str = "feed", seq: str = "file_seq", line: str = "line", record_key: str = "ref") -> DataFrame:
    """``(producer, seq, ref, field, kind, num, h)``: one row per top-level key that has a value.

    ``ref`` and ``h`` are hashes of record key and value, ``num`` the exact type of a number.
    """
    p = parsed(lines, producer, seq, line).where("producer is not null and seq is not null")
    p = p.withColumn("ref", F.expr(f"try_variant_get(v, '$.{record_key}', 'string')"))
    e = p.lateralJoin(p.sparkSession.tvf.variant_explode(F.col("v").outer()))
    e = e.select("producer", "seq", "ref", F.col("key").alias("field"), "value").where("not is_variant_null(value)").withColumn("text", F.to_json("value"))
    e = e.select("producer", "seq", "ref", "field", "value", "text", _kind(F.col("text")).alias("kind"))
    hashed = lambda c: F.when(F.col("ref").isNotNull(), F.xxhash64(c))
    return e.select("producer", "seq", hashed("ref").alias("ref"), "field", "kind", F.when(F.col("kind") == "number", F.expr("schema_of_variant(value)")).alias("num"), hashed("text").alias("h"))


def files_of(lines: DataFrame, producer: str = "feed", seq: str = "file_seq") -> DataFrame:
    """``(producer, seq, n, last)``: the files of a producer numbered from 1 in the order of ``seq``; ``last`` is their number."""
    files = lines.select(F.col(producer).alias("producer"), F.col(seq).cast("long").alias("seq")).where("producer is not null and seq is not null").distinct()
    by = Window.partitionBy("producer")
    return files.select("producer", "seq", F.row_number().over(by.orderBy("seq")).alias("n"), F.count("*").over(by).alias("last"))


def catalogue_of(e: DataFrame, files: DataFrame) -> DataFrame:
    """``(producer, seq, n, last, field, kind, nums)`` of :func:`entries`: the types of every field of every file."""
    seen = e.groupBy("producer", "seq", "field", "kind").agg(F.array_sort(F.collect_set("num")).alias("nums"))
    return files.join(seen, ["producer", "seq"])


def catalogue(lines: DataFrame, producer: str = "feed", seq: str = "file_seq", line: str = "line") -> DataFrame:
    """:func:`catalogue_of` the lines."""
    return catalogue_of(entries(lines, producer, seq, line), files_of(lines, producer, seq))


def lifespans(cat: DataFrame) -> DataFrame:
    """``(producer, field, kind, first_n, last_n, first_seq, last_seq, files, last)``: the islands of every producer, field and type."""
    w = Window.partitionBy("producer", "field", "kind").orderBy("n")
    begins = F.coalesce(F.lag("n").over(w) != F.col("n") - 1, F.lit(True))
    return (
        cat.select("producer", "seq", "n", "last", "field", "kind", begins.cast("int").alias("begins"))
        .withColumn("island", F.sum("begins").over(w))
        .groupBy("producer", "field", "kind", "island")
        .agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("files"), F.max("last").alias("last"))
        .drop("island")
    )


def raw_changes(spans: DataFrame) -> DataFrame:
    """``(producer, n, change, field)`` from the log of starting and ending islands; files are numbered per producer."""
    log = spans.select(
        "producer", "field", "last",
        F.explode(F.array(
            F.struct(F.col("first_n").alias("n"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
            F.struct((F.col("last_n") + 1).alias("n"), F.lit(0).alias("starts"), F.lit(1).alias("ends")),
        )).alias("x"),
    ).select("producer", "field", "last", "x.*")
    log = log.groupBy("producer", "field", "n").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("last").alias("last"))
    alive = F.sum(F.col("starts") - F.col("ends")).over(Window.partitionBy("producer", "field").orderBy("n"))
    log = log.withColumn("after", alive).withColumn("before", F.col("after") - F.col("starts") + F.col("ends"))
    change = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").otherwise("type_changed")
    return log.where("n > 1 and n <= last").select("producer", "n", change.alias("change"), "field")


def renames(e: DataFrame, files: DataFrame, raw: DataFrame) -> DataFrame:
    """``(producer, n, field, new_field)``: fields that ended where another started with their values.

    Each value of a field that ended is taken from the file before, of one that started from the file itself.
    """
    at = files.select("producer", "seq", "n")
    gone = raw.where("change = 'removed'").select("producer", "n", "field", F.lit(True).alias("old")).join(at.select("producer", (F.col("n") + 1).alias("n"), "seq"), ["producer", "n"])
    come = raw.where("change = 'added'").select("producer", "n", "field", F.lit(False).alias("old")).join(at, ["producer", "n"])
    # Only changes with both an end and a start can hold a rename.
    both = raw.where("change <> 'type_changed'").groupBy("producer", "n").agg(F.count_distinct("change").alias("k")).where("k = 2").select("producer", "n")
    marks = gone.unionByName(come).join(both, ["producer", "n"], "left_semi")
    # Distinct values of the fields that changed, a small part of the records; joins on them meet only the fields of one
    # record, or equal values, so a record key that fills a file multiplies nothing.
    values = e.where("ref is not null").select("producer", "seq", "ref", "field", "h")
    v = cut(values.join(marks, ["producer", "seq", "field"]).select("producer", "n", "ref", "old", "field", "h").distinct())
    record, pair = ["producer", "n", "ref"], ["producer", "n", "field", "new_field"]
    old, new = v.where("old").drop("old"), v.where("not old").select(*record, F.col("field").alias("new_field"), "h")
    of = old.drop("h").distinct().join(new.drop("h").distinct(), record).groupBy(*pair).agg(F.count("*").alias("of"))
    same = old.join(new, [*record, "h"]).select(*pair, "ref").distinct().groupBy(*pair).agg(F.count("*").alias("same"))
    scored = of.join(same, pair).where(F.col("same") >= SAME_VALUES * F.col("of"))
    # The pairs of one file, as many as its fields unless several hold the same values; the best one left is taken until
    # none is left.
    order = F.struct((-F.col("same") / F.col("of")).alias("share"), (-F.col("same")).alias("same"), "field", "new_field")
    none = F.array().cast("array<struct<field:string,new_field:string>>")
    free = lambda got, x: ~F.exists(got, lambda g: (g["field"] == x["field"]) | (g["new_field"] == x["new_field"]))
    taken = F.aggregate(F.array_sort("pairs"), none, lambda got, x: F.when(free(got, x), F.concat(got, F.array(F.struct(x["field"].alias("field"), x["new_field"].alias("new_field"))))).otherwise(got))
    best = scored.groupBy("producer", "n").agg(F.collect_list(order).alias("pairs")).select("producer", "n", F.explode(taken).alias("x"))
    return best.select("producer", "n", "x.field", "x.new_field")


class Drift:
    """What the files of all producers hold: the lines are parsed once, everything else is derived from the narrow table."""

    def __init__(self, lines: DataFrame, producer: str = "feed", seq: str = "file_seq", line: str = "line", record_key: str = "ref"):
        self.entries = stored(entries(lines, producer, seq, line, record_key))
        self.files = cut(files_of(lines, producer, seq))  # files without any field end fields, too
        self.catalogue = cut(catalogue_of(self.entries, self.files))

    def changes(self) -> DataFrame:
        """``(producer, seq, change, field, new_field)``: every change of a file against the file before it."""
        raw = cut(raw_changes(lifespans(self.catalogue)))
        ren = renames(self.entries, self.files, raw)
        ends = ren.select("producer", "n", "field", F.lit("removed").alias("change"), F.col("new_field").alias("to"))
        starts = ren.select("producer", "n", F.col("new_field").alias("field"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("to"), F.lit(True).alias("drop"))
        marks = ends.withColumn("drop", F.lit(False)).unionByName(starts)
        return (
            raw.join(marks, ["producer", "n", "field", "change"], "left")
            .where("not coalesce(drop, false)")
            .select("producer", "n", F.when(F.col("to").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "field", F.coalesce("to", F.lit("")).alias("new_field"))
            .join(self.files, ["producer", "n"])
            .select("producer", "seq", "change", "field", "new_field")
        )


def changes(lines: DataFrame, producer: str = "feed", seq: str = "file_seq", line: str = "line", record_key: str = "ref") -> DataFrame:
    """:meth:`Drift.changes` of the lines."""
    return Drift(lines, producer, seq, line, record_key).changes()


# ---------------------------------------------------------------------------------------------------------------------
# One consistent table


def column_type(kinds: Iterable[str], nums: Iterable[str]) -> str:
    """The narrowest type that holds every value exactly: bigint, decimal, double, boolean, else the text."""
    kinds, nums = set(kinds), set(nums)
    if kinds == {"boolean"}:
        return "boolean"
    if kinds != {"number"}:
        return "string"
    sizes = [(int(p) - int(s), int(s)) for p, s in (re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", n).groups() for n in nums if n.startswith("DECIMAL"))]
    if "BIGINT" in nums:
        sizes.append((19, 0))
    if not nums & {"DOUBLE", "FLOAT"}:
        whole, part = max(w for w, _ in sizes), max(s for _, s in sizes)
        return "bigint" if nums == {"BIGINT"} else f"decimal({whole + part},{part})" if whole + part <= 38 else "string"
    # A double holds 15 digits of whatever was written.
    return "double" if all(w + s <= 15 for w, s in sizes) else "string"


class Aliases:
    """The alias table: which column each field of each file goes to, and the type of each column.

    Fields joined by a rename anywhere are one column, named as most files name it.  Where a file holds several fields of one
    column at once, the first of them (the column's own name, else the more frequent) keeps the column and the others stand
    under their own names in that file, so no value is lost.
    """

    def __init__(self, change_log: DataFrame, cat: DataFrame):
        edges = change_log.where("change = 'renamed'").select("field", "new_field").distinct().limit(MOST_ALIASES + 1).collect()
        fields = cat.groupBy("field").agg(F.count_distinct("producer", "seq").alias("files"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("nums")))).alias("nums")).limit(MOST_ALIASES + 1).collect()
        if max(len(edges), len(fields)) > MOST_ALIASES:
            raise ValueError(f"more than {MOST_ALIASES} field names: no table can have that many columns")
        root = {r.field: r.field for r in fields}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for e in edges:
            root[find(e.field)] = find(e.new_field)
        groups = defaultdict(list)
        for r in fields:
            groups[find(r.field)].append(r)
        #: Column to its fields, most frequent first.
        self.fields: dict[str, list[str]] = {}
        seen = {r.field: r for r in fields}
        for rows in groups.values():
            rows.sort(key=lambda r: (-r.files, r.field))
            self.fields[rows[0].field] = [r.field for r in rows]
        self.fields = dict(sorted(self.fields.items()))
        shared = {f: (c, i) for c, fs in self.fields.items() if len(fs) > 1 for i, f in enumerate(fs)}
        #: ``(producer, seq, own)``: files in which fields stand under their own names.
        self.apart: DataFrame | None = None
        self.own: list[str] = []
        if shared:
            column = F.create_map(*[F.lit(x) for f, (c, _) in shared.items() for x in (f, c)])
            rank = F.create_map(*[F.lit(x) for f, (_, i) in shared.items() for x in (f, i)])
            once = cat.select("producer", "seq", "field").distinct().withColumn("column", column[F.col("field")]).where("column is not null")
            w = Window.partitionBy("producer", "seq", "column").orderBy(rank[F.col("field")])
            apart = once.withColumn("i", F.row_number().over(w)).where("i > 1").groupBy("producer", "seq").agg(F.array_sort(F.collect_set("field")).alias("own"))
            self.apart = cut(apart)
            self.own = sorted(r.f for r in self.apart.select(F.explode("own").alias("f")).distinct().collect())
        self.types = {c: column_type((k for f in fs for k in seen[f].kinds), (n for f in fs for n in seen[f].nums)) for c, fs in self.fields.items()}
        self.types |= {f: column_type(seen[f].kinds, seen[f].nums) for f in self.own if f not in self.types}


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _cells(lines: DataFrame, aliases: Aliases, producer: str, seq: str, line: str, keep: tuple[str, ...], as_text: bool) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The parsed records and (column of the alias table, its value)."""
    p = parsed(lines, producer, seq, line, keep)
    if aliases.own:
        p = p.join(aliases.apart, ["producer", "seq"], "left")
    apart = lambda f: F.coalesce(F.array_contains("own", f), F.lit(False))
    get = lambda f, c: F.try_variant_get(F.col("v"), _path(f), "string" if as_text else aliases.types[c])
    out = [(c, F.coalesce(*[get(f, c) if f == c or f not in aliases.own else F.when(~apart(f), get(f, c)) for f in fs])) for c, fs in aliases.fields.items()]
    return p, out + [(f, F.when(apart(f), get(f, f))) for f in aliases.own]


def unified(lines: DataFrame, aliases: Aliases, producer: str = "feed", seq: str = "file_seq", line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """All records of all files under the columns of the alias table, each cast to the one type that holds every value.

    A column that clashes with one already there gets a trailing underscore.
    """
    p, cells = _cells(lines, aliases, producer, seq, line, keep, False)
    taken, cols = {producer.lower(), seq.lower(), *map(str.lower, keep)}, []
    for name, value in cells:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        cols.append(value.alias(name))
    return p.select(F.col("producer").alias(producer), F.col("seq").alias(seq), *keep, *cols)


def long_values(lines: DataFrame, aliases: Aliases, keep: str, producer: str = "feed", seq: str = "file_seq", line: str = "line") -> DataFrame:
    """``(producer, seq, keep, column, value)``: the filled cells of :func:`unified` as texts."""
    p, cells = _cells(lines, aliases, producer, seq, line, (keep,), True)
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in cells]))
    return p.select(F.col("producer").alias(producer), F.col("seq").alias(seq), keep, x.alias("x")).select(producer, seq, keep, "x.column", "x.value").where("value is not null")
