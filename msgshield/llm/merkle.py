"""A Merkle manifest of a table: digests of rows, trees of three per source, and a proof for every row.

The leaves of a source are cut into aligned blocks; a block is a leaf partition of the octopus multiproof. It derives
all nodes above its own leaves by itself, so the nodes it lacks are the other members of the runs on its path to the
root. Each block computes these coordinates, fetches them all with one join, and expands the proofs of its rows locally.
The trees are built a block of levels at a time, so the number of shuffles is the height divided by ``SPAN_LEVELS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, numbered, stored

ARITY = 3
# Levels that a block derives by itself: 2,187 leaves.
SPAN_LEVELS = 7
SPAN = ARITY**SPAN_LEVELS
# Name of the tree of the sources; those of the sources begin with 0 (null) or 1.
TOP = ""

NODES = "tree string, level int, place long, node string, n long, root boolean"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof list<string>, folded_root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its UTF-8 length in front, so that no two rows have one input; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a document with ``text`` in the place of its text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tree_name(source: Column) -> Column:
    """A name that sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def height(count: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them; every run of three, and a shorter last one, becomes its digest."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def missing(held: Iterable[int], level: int, count: int) -> list[tuple[int, int]]:
    """The least set of (level, place) that, with the nodes ``held`` of a level, gives the root of a tree of ``count`` leaves."""
    width, held, out = count, set(held), []
    for _ in range(level):
        width = -(-width // ARITY)
    while width > 1:
        runs = {place // ARITY for place in held}
        for run in sorted(runs):
            out += [(level, i) for i in range(ARITY * run, min(ARITY * run + ARITY, width)) if i not in held]
        held, width, level = runs, -(-width // ARITY), level + 1
    return out


def _grower(inner: bool):
    """The levels that one block of equal level spans, its own left out; without ``inner`` the last of them only."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree, level, count = (table.column(c)[0].as_py() for c in ("tree", "level", "n"))
        place, top = table.column("place")[0].as_py(), height(count)
        above = climb(table.column("node").to_pylist(), min(SPAN_LEVELS, top - level))[1:]
        out = []
        for step, nodes in enumerate(above, 1):
            if inner or step == len(above):
                first = place // ARITY**step
                out += [(tree, level + step, first + i, node, count, level + step == top) for i, node in enumerate(nodes)]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["tree", "level", "place", "node", "n", "root"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return grow


def _tiers(nodes: DataFrame, most: int, inner: bool) -> DataFrame:
    """The nodes above ``nodes`` (tree, place, node, n), tier by tier; ``most``: the largest n. ``root`` marks the roots.

    Of the first tier only the roots of blocks are kept unless ``inner``, as nothing outside a block asks for the rest.
    """
    above, level = None, 0
    while True:
        span = F.floor(F.col("place") / F.lit(SPAN)).alias("span")
        nodes = nodes.select("tree", F.lit(level).alias("level"), "place", "node", "n")
        grown = stored(nodes.groupBy("tree", span).applyInArrow(_grower(inner or level > 0), NODES), "nodes")
        above = grown if above is None else above.unionByName(grown)
        level += SPAN_LEVELS
        if ARITY**level >= most:
            return above
        nodes = grown.filter((F.col("level") == level) & ~F.col("root"))


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block lacks, in its own tree and in the tree of the sources."""
    names = ["tree", "block", "of", "level", "place"]
    for batch in batches:
        out = []
        for unit in batch.to_pylist():
            own = missing([unit["block"]], min(SPAN_LEVELS, height(unit["n"])), unit["n"])
            top = missing([unit["rank"]], 0, unit["trees"])
            for of, lacks in ((unit["tree"], own), (TOP, top)):
                out += [(unit["tree"], unit["block"], of, level, place) for level, place in lacks]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


Step = tuple[list[str], list[str]]


def _path(place: int, level: int, count: int, node_at) -> list[Step]:
    """For every level from ``level`` to the root: the members of the run before and after the node on the path."""
    steps, width = [], count
    for _ in range(level):
        width = -(-width // ARITY)
    while width > 1:
        first = place - place % ARITY
        run = range(first, min(first + ARITY, width))
        steps.append(([node_at(level, i) for i in run if i < place], [node_at(level, i) for i in run if i > place]))
        place, width, level = place // ARITY, -(-width // ARITY), level + 1
    return steps


def fold(node: str, steps: Iterable[Step]) -> str:
    """The root that a node and the members of the runs on its path give."""
    for before, after in steps:
        node = digest("".join((*before, node, *after)))
    return node


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """The proofs of the rows of one block."""
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    types = (pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.string())
    if not leaves.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    leaves = leaves.sort_by("place")
    block, n, rank, trees = (leaves.column(c)[0].as_py() for c in ("block", "n", "rank", "trees"))
    given = {(r["of"] == TOP, r["level"], r["place"]): r["node"] for r in fetched.to_pylist()}
    own = leaves.column("leaf").to_pylist()
    first = block * SPAN
    local = min(SPAN_LEVELS, height(n))
    levels = climb(own, local)
    tail = _path(block, local, n, lambda level, i: given[False, level, i])
    subroot = fold(levels[-1][0], tail)
    over = _path(rank, 0, trees, lambda level, i: given[True, level, i])
    root = fold(subroot, over)
    shared = [*tail, *over]
    siblings_above = [s for before, after in shared for s in (*before, *after)]
    proofs, folded = [], []
    for i, (leaf, changed) in enumerate(zip(own, leaves.column("tampered").to_pylist(), strict=True)):
        steps, at = [], i
        for nodes in levels[:local]:
            run = at - at % ARITY
            steps.append((nodes[run:at], nodes[at + 1 : run + ARITY]))
            at //= ARITY
        proofs.append([s for before, after in steps for s in (*before, *after)] + siblings_above)
        folded.append(fold(leaf if changed is None else changed, [*steps, *shared]))
    assert first + i == leaves.column("place")[i].as_py(), "a block has a gap"
    columns = (leaves.column("doc_id"), own, [subroot] * len(own), [root] * len(own), proofs, folded)
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def proofs(docs: DataFrame, tampered: Column, when: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (list of digests), folded_root for every row of ``docs``.

    ``docs``: doc_id, source, lang, n_chars, text; other columns are not read. ``tampered`` is the text that a row is
    checked with ``when`` that holds (null: it does not). Within a source, leaves ascend by doc_id (null first), rows that share one by
    their digest; repeated rows are leaves of their own. Null is a source and stands first. Null and empty values have
    different digests. An empty table has no root and gives no row.
    """
    changed = F.when(when, leaf_digest(tampered))
    digests = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tree_name(F.col("source")).alias("tree"),
        leaf_digest(F.col("text")).alias("leaf"), changed.alias("tampered"),
    )
    rows = numbered(stored(digests, "digests"), ["tree", "doc_id", "leaf"], "leaves")
    trees = stored(rows.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    most, sources = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    trees = numbered(trees, ["tree"], "ranked").withColumnRenamed("at", "rank").withColumn("trees", F.lit(sources))
    small = broadcast_if_small(stored(trees, "trees"))
    rows = rows.join(small, "tree").withColumn("place", F.col("at") - F.col("first"))
    rows = rows.withColumn("block", F.floor(F.col("place") / F.lit(SPAN)))
    rows = rows.select("tree", "block", "place", "doc_id", "leaf", "tampered", "n", "rank", "trees")

    nodes = _tiers(rows.select("tree", "place", F.col("leaf").alias("node"), "n"), most or 1, False)
    single = rows.filter("n = 1").select("tree", F.col("leaf").alias("node"))
    subroots = nodes.filter("root").select("tree", "node").unionByName(single).join(small, "tree")
    top = stored(subroots.select(F.lit(TOP).alias("tree"), F.col("rank").alias("place"), "node", F.col("trees").alias("n")), "subroots")
    coordinates = ["tree", "level", "place", "node"]
    nodes = nodes.select(*coordinates).unionByName(_tiers(top, sources, True).select(*coordinates))
    nodes = nodes.unionByName(top.withColumn("level", F.lit(0)).select(*coordinates))

    units = rows.filter(F.col("place") % SPAN == 0).select("tree", "block", "n", "rank", "trees")
    wanted = units.mapInArrow(_requests, "tree string, block long, of string, level int, place long")
    fetched = wanted.join(nodes.withColumnRenamed("tree", "of"), ["of", "level", "place"])
    return rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(
        _expand, PROOFS.replace("list<", "array<")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """The proof of every row, checked on a text that lost its line ends where 2 divides the CRC-32 of the doc_id.

    doc_id, leaf, subroot, root, proof_sha256 (of all digests of the proof in order), folded_root, verified. A row
    without a doc_id is not tampered with. For the rest see ``proofs``.
    """
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    stripped = F.translate(F.col("text"), "\n", "")
    found = proofs(docs, stripped, even & F.contains(F.col("text"), F.lit("\n")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
