"""Problem 3: records that differ only in white space, letter case, punctuation or field order become one record each.

Method: dictionary encoding.  In every Arrow batch each column is reduced to its distinct values; each distinct value is
canonicalised once and becomes an integer; a record is rewritten as the sorted tuple of its field-value integers, packed
into a few bytes; the compact tuples are grouped.

* The integer of a value is a 64-bit content hash of field and canonical form, so the dictionaries of all partitions
  agree without a join and without a driver.  Two different records meet only if every value in which they differ
  collides: for records that share all other fields that is 2^-64 a pair.
* ``key=value`` pairs behind the first ``?`` are fields of their own, so their order cannot matter.
* Only the tuples are shuffled, never the texts.  Groups are pre-aggregated to (smallest id, count) before the shuffle.
  Members get their group's smallest id back by a join that re-shuffles both sides, so that adaptive execution can split
  a group that holds a third of all rows; no group is ever collected.

Defined results: a null field equals one without words; a record of nulls only is a record like any other; empty tables
give empty results; repeated rows are copies of each other; texts of any length are canonicalised whole; ids may repeat
(equal ids count as copies, the smallest id stands for the set).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import cut

_WORDS = re.compile(r"[^\W_]+")
_LIMIT = 200_000


def words(text: str) -> str:
    """The words of a text: unbroken runs of letters and digits, ``%XX`` decoded, in one letter case."""
    if "%" in text:
        text = unquote(text)
    return " ".join(_WORDS.findall(text.lower()))


def number(field: str, canonical: str) -> int:
    """The integer identifier of a field's value."""
    return xxhash.xxh3_64_intdigest(f"{field}\x1f{canonical}")


def encode_plain(field: str, text: str | None) -> tuple[int, ...]:
    return (number(field, words(text) if text else ""),)


def encode_with_pairs(field: str, text: str | None) -> tuple[int, ...]:
    """The part before ``?`` and each pair behind it, as one integer each."""
    if not text or "?" not in text:
        return encode_plain(field, text)
    base, _, tail = text.partition("?")
    out = [number(field, words(base))]
    for pair in tail.split("&"):
        key, sep, value = pair.partition("=")
        k, v = words(key), words(value)
        if k or v:
            out.append(number(f"{field}?", f"{k}={v}" if sep else k))
    return tuple(out)


def _encoder(fields: list[str], with_pairs: frozenset[str]):
    """Arrow batches of (id, *fields) to (id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict] = {f: {} for f in fields}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            parts: list[tuple[np.ndarray, list[tuple[int, ...]]]] = []
            for i, f in enumerate(fields):
                d = b.column(i + 1).dictionary_encode(null_encoding="encode")
                make = encode_with_pairs if f in with_pairs else encode_plain
                cache = seen[f]
                if len(cache) > _LIMIT:
                    cache.clear()
                codes = []
                for v in d.dictionary.to_pylist():
                    c = cache.get(v)
                    if c is None:
                        c = cache[v] = make(f, v)
                    codes.append(c)
                parts.append((d.indices.to_numpy(zero_copy_only=False), codes))
            width = sum(np.fromiter((len(c) for c in codes), np.int64, len(codes))[idx] for idx, codes in parts)
            offsets = np.zeros(n + 1, np.int64)
            np.cumsum(width, out=offsets[1:])
            flat = np.empty(offsets[-1], np.uint64)
            at = offsets[:-1].copy()
            for idx, codes in parts:
                lens = np.fromiter((len(c) for c in codes), np.int64, len(codes))
                first = np.fromiter((c[0] for c in codes), np.uint64, len(codes))
                flat[at] = first[idx]
                at += 1
                most = int(lens.max(initial=1))
                if most > 1:  # values with pairs: one column of the padded codes at a time, for all rows that have it
                    table = np.zeros((len(codes), most), np.uint64)
                    table[np.arange(most) < lens[:, None]] = np.fromiter((x for c in codes for x in c), np.uint64)
                    for k in range(1, most):
                        rows = np.flatnonzero(lens[idx] > k)
                        flat[at[rows]] = table[idx[rows], k]
                        at[rows] += 1
            for w in np.unique(width):  # sort the tuples of one width at once
                rows = np.flatnonzero(width == w)
                where = offsets[rows][:, None] + np.arange(w)
                flat[where] = np.sort(flat[where], axis=1)
            key = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), key], names=["id", "key"])

    return run


def encode(df: DataFrame, id_col: str, fields: list[str], with_pairs: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """``(id, key)``: every record as its packed tuple of field-value integers."""
    narrow = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    names = [f"f{i}" for i in range(len(fields))]
    pairs = frozenset(f"f{i}" for i, f in enumerate(fields) if f in with_pairs)
    return narrow.mapInArrow(_encoder(names, pairs), "id long, key binary")


def collapse(df: DataFrame, id_col: str, fields: list[str], with_pairs: set[str] = frozenset()) -> DataFrame:
    """One row per distinct record: ``(keep_id, n_copies)``, the smallest id and the number of rows of the set."""
    return encode(df, id_col, fields, with_pairs).groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).drop("key")


def copies(df: DataFrame, id_col: str, fields: list[str], with_pairs: set[str] = frozenset()) -> DataFrame:
    """One row per copy but the first: ``(keep_id, copy_id)``."""
    enc = cut(encode(df, id_col, fields, with_pairs))
    sets = enc.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    # Keys with one byte more: both sides get a shuffle of their own, which is what lets adaptive execution split a hot key.
    # (Reversing them would treat bytes as text, which corrupts keys that are none.)
    longer = F.concat("key", F.lit(bytearray(b"\x00"))).alias("k")
    left, right = enc.select(longer, "id"), sets.select(longer, "keep_id")
    return left.join(right, "k").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
