"""Comparison inside groups of any size: groups are cut into blocks, and pairs of blocks are the units of work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, keys: Sequence[str], spread: str, block_rows: int) -> DataFrame:
    """``rows`` of every group with more than one row, copied to the pairs of blocks (``__i`` <= ``__j``) they take part in.

    A group of ``n`` rows has ``ceil(n / block_rows)`` blocks, dealt by a hash of ``spread``; a row of block ``b`` goes
    to the pairs of ``b`` with every block, so each two rows of a group meet in one unit: (i, j) for different blocks,
    (b, b) for the same one. ``__own`` is a row's block. A unit holds about two blocks however large the group is.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    blocks = F.ceil(F.col("__size") / F.lit(block_rows)).cast("int")
    dealt = rows.join(sizes, list(keys)).withColumn("__blocks", blocks)
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(spread)), F.col("__blocks")).cast("int")
    dealt = dealt.withColumn("__own", own)
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}).drop(
        "__size", "__blocks", "__other"
    )


def unit_columns(keys: Sequence[str]) -> list[str]:
    """The columns that name a unit."""
    return [*keys, "__i", "__j"]


def by_unit(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a unit together and in one task, one unit after the other."""
    columns = unit_columns(keys)
    return units.repartition(*columns).sortWithinPartitions(*columns)


def complete_units(
    batches: Iterator[pa.RecordBatch], columns: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, with the limits of the units, from batches whose rows are sorted by unit."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        limits = _limits(rows, columns)
        if len(limits) > 2:
            yield rows.slice(0, int(limits[-2])), limits[:-1]
        rest = rows.slice(int(limits[-2]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _limits(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for column in columns:
        values = rows.column(column).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


class Forest:
    """Union-find over 0..n-1. Its links leave it as stars: at most n - 1 edges for any number of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return int(root)

    def roots(self) -> np.ndarray:
        """The root of every node, all at once."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add links. Those inside a tree are sorted out in bulk before the rest are joined one by one."""
        while len(a):
            roots = self.roots()
            apart = roots[a] != roots[b]
            a, b = a[apart], b[apart]
            for x, y in zip(a[:1024].tolist(), b[:1024].tolist(), strict=True):
                p, q = self.find(x), self.find(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
            a, b = a[1024:], b[1024:]

    def stars(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(u, v): the node of every member of a tree and the least node of the tree, but for that one itself."""
        roots = self.roots()
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, node)
        v = least[roots]
        return node[node != v], v[node != v]
