"""Problem 6: fill containers of fixed capacity with items of varying length, leaving as little space empty as possible.

Method: minimum bin slack.  For each container the largest item left is set and a bitset subset-sum dynamic programme over
the lengths still available finds the fullest feasible combination, which is then removed.

The programme sees only how many items of each length are left.  There are at most ``capacity`` lengths, so it works on a
histogram of that bounded size whatever the number of items, and a combination is removed as often as the histogram
allows in one step.  Every step uses up a length, which bounds the number of different combinations.  Items are then
given their places in parallel: the n-th item of a length goes to the n-th place of that length.  Ranks within a length
are built from bounded buckets, so a length shared by a third of all items is spread over many tasks.

Defined results: null and empty texts have length 0, take no space and are spread evenly over the containers; an item above
the capacity is divided into full containers of its own and one remainder that is packed like any item; no other item is
divided; every item is placed exactly once; an empty table gives no rows; equal ids are different items.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeworks.llm.tokens import token_count
from lodeworks.session import cut

#: Rows of one length that one task ranks.
BUCKET_ROWS = 200_000


class Fill(NamedTuple):
    """``repeat`` containers that hold ``lengths[l]`` items of each length ``l``."""

    repeat: int
    lengths: dict[int, int]


def fullest(available: Mapping[int, int], target: int) -> dict[int, int]:
    """Multiset of available lengths with the greatest sum not above ``target``, by bitset subset sums."""
    mask = (1 << (target + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in available if 0 < x <= target), reverse=True):
        copies, part = min(available[length], target // length), 1
        while copies > 0:
            part = min(part, copies)
            trail.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            copies -= part
            part *= 2
        if reach >> target & 1:
            break
    best, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(trail):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + part
            best -= length * part
    return out


def minimum_bin_slack(counts: Mapping[int, int], capacity: int) -> list[Fill]:
    """Fills that place every item of the histogram ``counts``."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0 and 0 < k <= capacity}
    out = []
    while left:
        head = max(left)
        left[head] -= 1
        chosen = fullest(left, capacity - head)
        left[head] += 1
        chosen[head] = chosen.get(head, 0) + 1
        repeat = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= m * repeat
            if not left[k]:
                del left[k]
        out.append(Fill(repeat, chosen))
    return out


def places(fills: list[Fill]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs of places sorted by (length, first rank): keys, first ranks, first containers, items per container; and the number of containers."""
    runs, used, base = [], {}, 0
    for repeat, lengths in fills:
        for k, m in lengths.items():
            at = used.get(k, 0)
            runs.append((k, at, base, m))
            used[k] = at + repeat * m
        base += repeat
    runs.sort()
    a = np.array(runs or [(0, 0, 0, 1)], np.int64)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], base


def items(df: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """``(id, tokens, full, len)``: whole containers an item fills alone and the length of what is left to pack."""
    n = token_count(F.col(text_col))
    big = F.col("tokens") > capacity
    return df.select(F.col(id_col).cast("long").alias("id"), n.alias("tokens")).select(
        "id",
        "tokens",
        F.when(big, F.expr(f"tokens div {capacity}")).otherwise(F.lit(0)).cast("long").alias("full"),
        F.when(big, F.col("tokens") % capacity).otherwise(F.col("tokens")).cast("int").alias("len"),
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """``(id, piece, n_pieces, tokens, container_id)``: every item, or piece of a divided item, and its container.

    Containers are named ``s<number>`` when shared and ``d-<id>-<number>-<piece>`` when one divided item fills them.
    """
    it = cut(items(df, id_col, text_col, capacity))
    # The remainder of a divided item is packed unless nothing is left.
    small = it.where("full = 0 or len > 0")
    counts = {r["len"]: r["n"] for r in small.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    keys, first, base, per, n_bins = places(minimum_bin_slack(counts, capacity))
    n_bins = max(n_bins, 1)

    @F.pandas_udf(T.LongType())
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        ln, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.clip(np.searchsorted(keys, (ln << 44) + r, side="right") - 1, 0, None)
        return pd.Series(np.where(ln == 0, r % n_bins, base[i] + (r - first[i]) // per[i]))

    buckets = F.lit(1)
    if many := {k: -(-v // BUCKET_ROWS) for k, v in counts.items() if v > BUCKET_ROWS}:
        table = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
        buckets = F.coalesce(F.element_at(table, F.col("len")), F.lit(1))
    placed = small.withColumn("bucket", F.pmod(F.xxhash64("id"), buckets).cast("long"))
    offsets = (
        placed.groupBy("len", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy("len").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    ranked = (
        placed.withColumn("r", F.row_number().over(Window.partitionBy("len", "bucket").orderBy("id")) - 1)
        .join(offsets, ["len", "bucket"])
        .withColumn("c", container(F.col("len"), (F.col("r") + F.col("start")).cast("long")))
    )
    pieces = (F.col("full") + (F.col("len") > 0).cast("long")).alias("n_pieces")
    shared = ranked.select("id", F.col("full").alias("piece"), F.greatest(pieces, F.lit(1)).alias("n_pieces"), F.col("len").cast("long").alias("tokens"), F.concat(F.lit("s"), "c").alias("container_id"))
    # Only divided items get here; the number tells items of one id apart.
    alone = (
        it.where("full > 0")
        .withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("tokens")))
        .select("id", pieces, "no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        .select("id", "piece", "n_pieces", F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("d"), "id", "no", "piece").alias("container_id"))
    )
    return shared.unionByName(alone)


def divided(packed: DataFrame) -> DataFrame:
    """``(id, containers)`` of items whose pieces lie in more than one container."""
    return packed.where("n_pieces > 1").groupBy("id").agg(F.count_distinct("container_id").alias("containers")).where("containers > 1")


def container_use(packed: DataFrame) -> DataFrame:
    """``(container_id, used, pieces)``."""
    return packed.groupBy("container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the least number that the tokens need, the mean share filled, and the emptiest and fullest container."""
    u = container_use(packed)
    return u.agg(F.count("*").alias("containers"), F.ceil(F.sum("used") / capacity).alias("least"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("share"), F.min("used").alias("emptiest"), F.max("used").alias("fullest"))
