"""Placement of rows on shards by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At every inner node each child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the least draw wins, so a child is
chosen in proportion to its weight. A draw depends on the child alone: if weights change, rows move only into or out
of the subtrees that changed. Everything is a built-in expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, text_key

ROOT = "root"


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: where it stands and how much it holds. ``number`` is its shard id."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4) -> list[Shard]:
    """A regular tree of ``regions * racks * per_rack`` shards of equal weight; every further shard is a region of its own.

    So one more shard changes no existing subtree: the new region only takes rows away from the others.
    """
    full = regions * racks * per_rack
    tree = [
        Shard(f"r{n // (racks * per_rack)}", f"k{n // per_rack}", n) if n < full else Shard(f"r-{n}", f"k-{n}", n)
        for n in range(shards)
    ]
    return tree


def children(tree: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Node -> its children with their weights; an inner node weighs as much as its shards. Shards are named ``s<n>``."""
    weights: dict[tuple[str, str], float] = {}
    for leaf in tree:
        if leaf.weight > 0:
            rack = f"{leaf.region}/{leaf.rack}"
            for edge in ((ROOT, leaf.region), (leaf.region, rack), (rack, f"s{leaf.number}")):
                weights[edge] = weights.get(edge, 0.0) + leaf.weight
    out: dict[str, list[tuple[str, float]]] = {}
    for (parent, child), weight in weights.items():
        out.setdefault(parent, []).append((child, weight))
    return out


def uniform(key: Column, node: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a digest of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard number that the tree gives to a key (a string)."""
    below = children(tree)
    if not below:
        raise ValueError("the tree has no shard with a weight")
    edges = F.create_map(
        *[
            x
            for parent, nodes in below.items()
            for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in nodes]),
            )
        ]
    )
    node = F.lit(ROOT)
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(edges, node),
            lambda c: F.struct((-F.log(uniform(key, c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")),
        )
        node = F.array_min(draws)["node"]
    return F.substring(node, 2, 12).cast("int")


def place(df: DataFrame, key: str, tree: list[Shard], output: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. Null keys are one key; equal keys share a shard."""
    return df.withColumn(output, descend(F.coalesce(F.col(key).cast("string"), F.lit("")), tree))


def slots(df: DataFrame, key: str, shard: str = "shard", output: str = "slot") -> DataFrame:
    """Number the rows of every shard 0, 1, 2, ... in the order of a digest of the key.

    The digest's first three digits cut a shard into 4,096 even buckets; only bucket counts are summed in order.
    Repeated keys lie side by side in an order of their own columns ``size`` and ``text_crc32`` where those exist.
    """
    ties = [c for c in (key, "size", "text_crc32") if c in df.columns]
    rows = df.withColumn("__digest", F.md5(text_key(F.col(key)))).withColumn("__bucket", F.substring("__digest", 1, 3))
    totals = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    base = offsets(totals, [shard], ["__bucket"], ["__n"]).select(shard, "__bucket", "before___n")
    rank = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy("__digest", *ties))
    ranked = rows.withColumn("__rank", rank).join(base, [shard, "__bucket"])
    return ranked.withColumn(output, (F.col("before___n") + F.col("__rank") - 1).cast("long")).select(*df.columns, output)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row's shard, its place there, and its shard if there were one more.

    Size: UTF-8 bytes of the text (null: none) plus 8. The checksum of a null text is that of an empty one. The law is
    ``key``: key and shard count decide; one more shard takes rows only into itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, "doc_id", topology(shards))
    rows = place(rows, "doc_id", topology(shards + 1), "grown_shard")
    return slots(rows, "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
