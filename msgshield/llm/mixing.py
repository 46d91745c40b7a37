"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, its source's target over its source's size. The
expected copies are summed in order within the source, one random offset is added, and a document is emitted once for
each integer that its step crosses. The order is by size class, then by a digest of the key: neighbours have similar
sizes, so what one document takes too much its neighbours leave, and the words taken come near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, stored, text_key, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 20


def size_class(size: Column) -> Column:
    """Order-preserving classes: sizes below 256 each for themselves, then 128 for every doubling."""
    shift = F.greatest(F.length(F.bin(size)) - 8, F.lit(0))
    return (shift * 128 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of each source. ``sizes``: one row a source with ``source`` and ``source_size``.

    Sources in code point order, null last, take the weights in turn. ``share`` times all sizes is dealt by weight; a
    target stops at ``cap`` times the source's size and the excess is dealt again. That has a closed form: with the
    sources in order of capacity over weight, a source is full if its capacity is at most its part of what the earlier
    ones left. The windows hold one row for each source.
    """
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__rank", rank).withColumn("__weight", weight)
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(0))
    filling = everything.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))
    weights_left = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("__place", F.row_number().over(filling)).withColumn("__level", left / weights_left)
    rows = rows.withColumn("__full", F.col("__cap") <= F.col("__weight") * F.col("__level"))
    level = F.min_by("__level", F.when(~F.col("__full"), F.col("__place"))).over(everything)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__weight") * level)
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _mixed(
    docs: DataFrame, carry: Sequence[str], weights: Sequence[float], share: float, cap: float, seed: int
) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    The rows are stored with their sizes, so the words of a text are counted once.
    """
    rows = stored(
        docs.select(
            *carry, word_count(F.col("text")).alias("__size"), text_key(F.col("source")).alias("__source"),
            F.md5(F.concat(F.lit(f"{seed}:"), text_key(F.col("doc_id")))).alias("__digest"),
        ),
        "sized",
    )
    rows = rows.withColumn("__class", size_class(F.col("__size"))).withColumn("__bucket", F.substring("__digest", 1, 3))
    places = ["__source", "__class", "__bucket"]
    totals = rows.groupBy(*places).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    sizes = totals.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    name = F.when(F.col("__source") != "-", F.expr("substring(__source, 2)"))
    dealt = targets(sizes.withColumn("source", name), weights, share, cap).select(
        text_key(F.col("source")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    start = offsets(totals, ["__source"], ["__class", "__bucket"], ["__n"])
    start = start.join(dealt, "__source").select(*places, "before___n", "__source_size", "__target")
    rank = F.row_number().over(Window.partitionBy(*places).orderBy("__digest", "__size"))
    rows = rows.withColumn("__place", rank).join(start, places)
    # Offsets are multiples of 1/1024: then no sum is rounded over an integer.
    digest = F.md5(F.concat(F.lit(f"{seed}@"), F.col("__source")))
    offset = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % 1024 / F.lit(1024.0)
    step = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    end = (F.col("before___n") + F.col("__place")).cast("double")
    copies = F.floor(end * step + offset) - F.floor((end - 1) * step + offset)
    return rows.withColumn("__copies", F.least(copies, F.ceil(step)).cast("long"))


def mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and taken (copies times size).

    Only the columns ``carry`` are kept, by default all.

    Null and empty texts have size 0 and take nothing; null is a source of its own. Rows that repeat a doc_id are rows
    of their own. The same rows give the same mix on any cluster. Columns of these names in ``docs`` are replaced. An
    empty table gives no row.
    """
    made = ("size", "source_size", "target", "copies")
    kept = [c for c in carry or docs.columns if c not in (*made, "taken")]
    rows = _mixed(docs, kept, weights, share, cap, seed)
    return rows.select(
        *kept, *[F.col(f"__{c}").alias(c) for c in made], (F.col("__copies") * F.col("__size")).alias("taken")
    )


def emit(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED
) -> DataFrame:
    """The mix itself: every row of ``docs``, with its own columns, as often as it has copies.

    Null and empty texts have size 0 and the copies of any other row of their source. Rows that repeat are rows of their own.
    """
    rows = _mixed(docs, docs.columns, weights, share, cap, seed).filter(F.col("__copies") > 0)
    each = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")
    return rows.select(*docs.columns, each).select(*docs.columns)
