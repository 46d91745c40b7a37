"""Connected components by rounds of joins, with every round written to the shared folder.

Two rounds alternate: every node links its larger neighbours, then its smaller ones, to the least node around it.
Edges only ever become closer to a star around the least node of a component, and their number does not grow. A hub
keeps one row a neighbour: its least neighbour comes from an aggregate with partial sums, not from a gathered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(arcs: DataFrame) -> DataFrame:
    """Node -> the least of itself and its neighbours."""
    near = arcs.groupBy("u").agg(F.min("v").alias("m"))
    return near.select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = arcs.join(_least(arcs), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Edges that repeat go at the end of the round.
    return moved.filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(arcs)
    moved = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node is a centre or has one centre. One aggregate, no join."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: longs) -> (node, component): the least node reachable, for every node that has an edge.

    Self loops and repeated edges do no harm; edges with a null end are left out.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNull() | F.col("v").isNull())
    edges = stored(ordered.toDF("u", "v", "open").filter("NOT open AND u <> v").select("u", "v").distinct(), "edges")
    for _ in range(rounds):
        # In a star the centre is the least node, as each edge leads to the smaller end.
        if _settled(edges):
            break
        edges = stored(_small(_large(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
