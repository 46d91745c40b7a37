"""Collapse of cumulative conversation logs, then rendering.

A chat that is logged after every turn leaves snapshots that are prefixes of one another. A rolling hash over the turns
names every prefix; a conversation whose last hash is also an inner prefix of a longer one is dropped by an anti-join,
and of equal conversations the least id stays. The rolling hash is a sum of turn hashes, so a conversation of any
length is summed in pieces and no task holds it whole. Everything is a built-in function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import offsets, text_key

LANES = ["__l0", "__l1", "__l2", "__l3"]
VALUES = ["__n", *LANES]
# Turns of one rendered part.
PART_BITS = 6


def _lanes() -> list[Column]:
    """128 bits of a turn's hash as four numbers of 32 bits, so that sums cannot overflow."""
    turn = [F.col("__turn"), text_key(F.col("turn")), text_key(F.col("role")), text_key(F.col("text"))]
    out = []
    for i in range(2):
        h = F.xxhash64(F.lit(i), *turn)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [c.cast("long").alias(n) for c, n in zip(out, LANES)]


def distinct_turns(log: DataFrame) -> DataFrame:
    """Turns without repeated rows, with position and hash. A null turn comes first; a null conv_id is one conversation."""
    rows = log.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("__conv", text_key(F.col("conv_id")))
    rows = rows.withColumn("__turn", F.coalesce(F.col("turn").cast("long"), F.lit(-1)))
    return rows.withColumns({n: c for n, c in zip(LANES, _lanes())})


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, __conv, n_turns) that are no proper prefix of another, one of each set of equal ones."""
    each = turns.groupBy("__conv", "__turn").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(x).alias(x) for x in LANES])
    each = each.withColumn("__b2", F.shiftright("__turn", 20)).withColumn("__b1", F.shiftright("__turn", 10))
    before = offsets(each, ["__conv"], ["__b2", "__b1", "__turn"], VALUES)
    prefixes = before.select(*[(F.col(f"before_{v}") + F.col(v)).alias(v) for v in VALUES])
    shared = prefixes.groupBy(*VALUES).agg(F.count(F.lit(1)).alias("__having"))
    ends = turns.groupBy("__conv", "conv_id").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(x).alias(x) for x in LANES])
    equal = ends.groupBy(*VALUES).agg(
        F.count(F.lit(1)).alias("__ending"), F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "__conv")).alias("__first")
    )
    inner = shared.join(equal, VALUES).filter(F.col("__having") > F.col("__ending")).select(*VALUES)
    kept = equal.join(inner, VALUES, "left_anti")
    return kept.select(
        F.col("__first.conv_id").alias("conv_id"), F.col("__first.__conv").alias("__conv"), F.col("__n").alias("n_turns"),
        (F.col("__ending") - 1).alias("n_copies"),
    )


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat markup; null role and text render empty."""
    empty = F.lit("")
    return F.concat(
        F.lit("<|im_start|>"), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty), F.lit("<|im_end|>\n")
    )


def collapse_and_render(log: DataFrame) -> DataFrame:
    """Maximal conversations rendered: conv_id, part, n_turns, n_copies, part_turns, text.

    ``log``: conv_id, turn, role, text; other columns are ignored. A part holds the turns of one range of 64 turn
    numbers, so a conversation of up to 64 turns is one row and a longer one several rows in order. n_copies counts the
    dropped equal conversations. Turns with one number are put in order of role and text, nulls first. An empty log
    gives no row.
    """
    turns = distinct_turns(log)
    kept = maximal(turns).select("__conv", "n_turns", "n_copies")
    rows = turns.select("__conv", "conv_id", "__turn", "role", "text").join(kept, "__conv")
    part = F.shiftright("__turn", PART_BITS).cast("long")
    piece = F.struct("__turn", "role", "text", rendered(F.col("role"), F.col("text")).alias("out"))
    parts = rows.groupBy("__conv", "conv_id", "n_turns", "n_copies", part.alias("part")).agg(
        F.array_sort(F.collect_list(piece)).alias("__pieces")
    )
    return parts.select(
        "conv_id", "part", "n_turns", "n_copies", F.size("__pieces").cast("long").alias("part_turns"),
        F.concat_ws("", F.col("__pieces.out")).alias("text"),
    )
