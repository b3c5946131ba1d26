"""Texts of commands and files as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text a concatenation may reach; longer ones are null.
LONGEST = 10_000


def concat_capped(*parts: Column) -> Column:
    out = F.concat(*parts)
    return F.when(F.length(out) < LONGEST, out)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def decode_base64(text: Column) -> Column:
    """Text of padded or unpadded base64; null if it is none or no text."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s", ""), "=+$", "")
    ok = t.rlike("^[A-Za-z0-9+/]+$") & (F.length(t) % 4 != 1)
    raw = F.unbase64(F.when(ok, F.concat(t, F.repeat(F.lit("="), (4 - F.length(t) % 4) % 4))))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def best_effort(data: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    s = data.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.decode(data, "ISO-8859-1"))


def split_literal(text: Column, delimiter: str) -> Column:
    """Parts between a literal delimiter."""
    return F.split(text, r"\Q" + delimiter + r"\E")


def quoted_words(command: Column) -> Column:
    """Words of a command line without their quotes (no escapes)."""
    raw = F.regexp_extract_all(command, F.lit(r"""((?:[^\s"']+|"[^"]*"|'[^']*')+)"""), F.lit(1))
    return F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, "\"([^\"]*)\"", "$1"), "'([^']*)'", "$1"))


def keyword_in_name(path: Column, keywords: Sequence[str]) -> Column:
    """A file name holds one of the words as a word of its own."""
    return F.lower(basename(path)).rlike(rf"(?:^|[^a-z])(?:{'|'.join(keywords)})(?:[^a-z]|$)")


DEPLOY_WORDS = ("deploy", "deployment", "publish", "release")
TEST_WORDS = ("test", "tests", "snapshot", "debug")


def deploy_evidence(path: Column, called_by_release: Column) -> Column:
    """Confidence that a workflow deploys: its name says so, it runs on a release, and its name says nothing of tests."""
    w = keyword_in_name(path, DEPLOY_WORDS).cast("int") + F.coalesce(called_by_release, F.lit(False)).cast("int") + (~keyword_in_name(path, TEST_WORDS)).cast("int")
    share = w / 3
    return F.when(share >= 0.85, 1.0).when(share >= 0.55, 0.7).otherwise(0.4)


def ini_entries(text: Column) -> Column:
    """``section``, ``key`` and ``value`` of a configuration text; indented lines go on with a value, ``#`` and ``;`` start comments."""
    lines = F.filter(F.split(F.regexp_replace(text, r"\r?\n[ \t]+(?=\S)", "\x01"), r"\r?\n"), lambda x: ~x.rlike(r"^\s*(?:[#;].*)?$"))
    zero = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,key:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        section = F.regexp_extract(x, r"^\s*\[([^\]]+)\]\s*$", 1)
        p = r"(?s)^\s*([^=:\x01]+?)\s*[=:]\s*(.*)$"
        entry = F.struct(acc["section"].alias("section"), F.lower(F.regexp_extract(x, p, 1)).alias("key"), F.replace(F.regexp_extract(x, p, 2), F.lit("\x01"), F.lit("\n")).alias("value"))
        return F.when(section != "", F.struct(section.alias("section"), acc["out"].alias("out"))).when(x.rlike(p), F.struct(acc["section"].alias("section"), F.concat(acc["out"], F.array(entry)).alias("out"))).otherwise(acc)

    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def ini_list(value: Column, delimiter: str | None = None) -> Column:
    """A configuration value as a list: its lines, or its parts at a delimiter, trimmed, each once, without empty ones."""
    parts = F.split(value, r"\Q" + delimiter + r"\E" if delimiter else r"\r?\n")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def json_cells(text: Column) -> Column:
    """Elements of a JSON list in a table cell; a cell that is no list has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<string>"), F.array().cast("array<string>"))


def single_word(text: Column) -> Column:
    """Is a shell text one word: no unquoted white space or operator, quotes closed."""
    return text.rlike(r"""^(?:[^\s"'`;&|<>()$\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*'|\$\{?\w+\}?)+$""")


def python_command(words: Column) -> Column:
    """``interpreter``, ``module``, ``script`` and ``args`` of a Python command line given as words; null for other programs."""
    name = F.element_at(F.split(F.try_element_at(words, F.lit(1)), "/"), -1)
    flags = F.array_position(F.transform(words, lambda w: F.when(w == "-m", "m").when(w == "-c", "c").otherwise("")), "m").cast("int")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    plain = F.filter(rest, lambda w: ~w.startswith("-"))
    module = F.when(flags > 0, F.try_element_at(words, flags + 1))
    script = F.when(flags == 0, F.try_element_at(plain, F.lit(1)))
    after = F.when(flags > 0, F.slice(words, flags + 2, F.greatest(F.size(words) - flags - 1, F.lit(0)))).otherwise(F.slice(rest, F.array_position(rest, script).cast("int") + 1, F.size(rest)))
    return F.when(name.rlike(r"^python[0-9.]*$"), F.struct(name.alias("interpreter"), module.alias("module"), script.alias("script"), F.coalesce(after, F.array().cast("array<string>")).alias("args")))
