"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside the cells, one row kept a group.

Equal vectors of one label are one representative with a count. A label's vectors are dealt to the nearest of its
centroids, at most the root of their number; cells that are still large are dealt again where that leaves fewer pairs.
A vector can have a partner in another cell only if it lies close to the plane between the two centroids; it notes such
cells of lower numbers, so no pair is lost at a border and none is compared twice. Cells of any size are packed into
blocks, which are stored once: tasks read pairs of stored blocks, so the disk holds no copy for a pair. Centroids are
fitted in tasks and joined to the vectors; nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components
from .pairs import Forest, complete_units

THRESHOLD = 0.93
BLOCK_ROWS = 1024
# A centroid is fitted on so many vectors of a sample, at most so many centroids at once; every vector is assigned.
CENTROID_ROWS, MOST_CENTROIDS = 64, 2048
# Cells that a vector visits beside its own on average, at most, as found on so many vectors of the sample.
VISITS, PROBE_ROWS = 2.0, 4096
# Cells with more rows are dealt to centroids of their own, as often as there are levels, if that leaves a smaller share of pairs.
CELL_ROWS, LEVELS, PAYS = 8192, 3, 0.9
# Rows that meet the centroids in one group.
DEAL_ROWS = 4096
KEYS = ["label", "dims"]
UNIT = [*KEYS, "cell", "slot"]


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centroids of unit vectors; a cell that empties keeps its centroid."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        centroids[full] = sums[full] / norms[full, None]
    return centroids


def unit_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_vectors(flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 0)))


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, none of them zero, as unit rows."""
    # Scaled first, so that neither huge nor tiny components leave the range of a double when squared.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linkable() -> Column:
    """Whether a row can have links; never null."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    return F.coalesce(known & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), F.lit(False))


def _kind(vectors: DataFrame) -> str:
    """The type in which components are kept: single precision where they are given so."""
    return "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every linkable row with its class, and the classes with vector and number of rows.

    A row is linkable if vec_id, label and vector are not null, and the vector has a component that is not zero and
    none that is null or not finite. The class of equal vectors of a label is their least vec_id.
    """
    v = F.col("embedding")
    rows = vectors.filter(linkable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"), v.cast(f"array<{_kind(vectors)}>").alias("embedding"),
    )
    equal = ["label", "h1", "h2"]
    classes = stored(
        rows.groupBy(*equal).agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
        ),
        "classes",
    )
    return rows.select("vec_id", *equal), classes


def visits(vectors: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of every vector, whether it visits each lower cell)."""
    near = vectors @ centroids.T
    own = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0)) + 1e-7
    found = near.max(axis=1)[:, None] - near <= reach * gap[own]
    return own, found & (np.arange(len(centroids))[None, :] < own[:, None])


def _step(level: int) -> int:
    """The cell is a number of ``LEVELS`` digits, one a level; this is what the digit of a level counts."""
    return MOST_CENTROIDS ** (LEVELS - 1 - level)


def _split(vectors: np.ndarray, threshold: float, level: int) -> np.ndarray | None:
    """The centroids of one cell from its part of the sample; below the first level, none if they leave nearly all pairs.

    The more of them, the more cells a vector near borders visits: their number is halved until the sample's vectors visit
    ``VISITS`` cells or fewer on average, or two are left."""
    probe = vectors[:PROBE_ROWS]
    k = max(2, min(len(vectors) // CENTROID_ROWS, MOST_CENTROIDS))
    while True:
        centroids = spherical_kmeans(vectors, k).astype(np.float32).astype(np.float64)
        own, visited = visits(probe, centroids, _reach(threshold))
        if k <= 2 or visited.sum(axis=1).mean() <= VISITS:
            break
        k = max(2, k // 2)
    home = np.bincount(own, minlength=k)
    pairs = (home * (home - 1) // 2 + home * visited.sum(axis=0)).sum()
    return centroids if level == 0 or pairs < PAYS * len(probe) * (len(probe) - 1) / 2 else None


TREE = "label long, dims int, n long, depth int, level array<int>, prefix array<long>, k array<int>, centroids array<float>, leaf array<long>, share array<double>"


def _fitter(threshold: float):
    """The cells of one label from its sample, end to end: centroids of every cell that is dealt, and what share each leaf has."""

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        # The first centroids are rows of a fixed random order.
        n = rows.column("size")[0].as_py()
        vectors = unit_rows(rows.sort_by("node").column("embedding").combine_chunks())
        vectors = vectors[np.random.default_rng(7).permutation(len(vectors))]
        found, leaves, dealt = [], [], [(0, 0, np.arange(len(vectors)))]
        while dealt:
            level, prefix, at = dealt.pop()
            large = not level or (len(at) * n > CELL_ROWS * len(vectors) and len(at) >= 2 * CENTROID_ROWS)
            if level == LEVELS or not large or (centroids := _split(vectors[at], threshold, level)) is None:
                leaves.append((prefix, len(at) / len(vectors)))
                continue
            found.append((level, prefix, len(centroids), centroids.astype(np.float32).ravel()))
            own = (vectors[at] @ centroids.T).argmax(axis=1)
            dealt += [(level + 1, prefix + c * _step(level), at[own == c]) for c in range(len(centroids))]
        found.sort(key=lambda x: x[:2])
        leaves.sort()
        values = {
            "label": key[0].as_py(), "dims": key[1].as_py(), "n": n, "depth": 1 + found[-1][0], "level": [x[0] for x in found],
            "prefix": [x[1] for x in found], "k": [x[2] for x in found], "centroids": np.concatenate([x[3] for x in found]),
            "leaf": [x[0] for x in leaves], "share": [x[1] for x in leaves],
        }
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *map(pa.list_, (pa.int32(), pa.int64(), pa.int32(), pa.float32(), pa.int64(), pa.float64()))]
        return pa.table({c: pa.array([v], kind) for (c, v), kind in zip(values.items(), kinds, strict=True)})

    return fit


def _reach(threshold: float) -> float:
    """The distance of unit vectors at that cosine."""
    return float(np.sqrt(2 - 2 * threshold)) + 1e-9


def fit_cells(rows: DataFrame, threshold: float) -> DataFrame:
    """The cells (``TREE``) of every label with twice ``CENTROID_ROWS`` vectors of one length, two at least each.

    A label of n rows gets the root of n centroids or fewer a level, one for every ``CENTROID_ROWS`` rows of a sample chosen by
    hash; the sample of a label is one group and has at most ``CENTROID_ROWS * MOST_CENTROIDS`` rows but for chance.
    """
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2 * CENTROID_ROWS)
    k = F.least(F.ceil(F.sqrt("size")), F.floor(F.col("size") / F.lit(CENTROID_ROWS)), F.lit(MOST_CENTROIDS))
    sizes = stored(sizes.withColumn("share", F.least(F.lit(1.0), k * F.lit(CENTROID_ROWS * 1.1) / F.col("size"))), "sizes")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.lit(0), "node"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    sample = rows.join(sizes, KEYS).filter(drawn).select(*KEYS, "size", "node", "embedding")
    return stored(sample.groupBy(*KEYS).applyInArrow(_fitter(threshold), TREE), "centroids")


def _dealer(threshold: float):
    def deal(rows: pa.Table, given: pa.Table) -> pa.Table:
        names = [*KEYS, "node", "n", "embedding"]
        vectors = unit_rows(rows.column("embedding").combine_chunks(), 1)
        cell, noted, begin = np.zeros(len(vectors), np.int64), [(np.zeros(0, int), np.zeros(0, int))], 0
        tree = {c: given.column(c).combine_chunks().flatten().to_numpy() for c in ("level", "prefix", "k", "centroids", "leaf", "share")}
        for level, prefix, k in zip(tree["level"].tolist(), tree["prefix"].tolist(), tree["k"].tolist(), strict=True):
            width = k * vectors.shape[1]
            c = tree["centroids"][begin : begin + width].astype(np.float64).reshape(k, -1)
            begin += width
            # Above this level the digits agree; the rows' own digit is not set yet.
            at = np.flatnonzero(cell == prefix)
            own, visited = visits(vectors[at], c, _reach(threshold))
            cell[at] += own * _step(level)
            a, b = np.nonzero(visited)
            noted.append((at[a], (prefix + b * _step(level)) * LEVELS + level))
        row, tag = (np.concatenate(x) for x in zip(*noted, strict=True))
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(cell)))]).astype(np.int32)
        noted = pa.ListArray.from_arrays(pa.array(ends), pa.array(tag[order].astype(np.int64)))
        # So many parts of a label have a block of rows of that cell.
        share = np.zeros(0) if not len(cell) else tree["share"][np.minimum(np.searchsorted(tree["leaf"], cell), len(tree["leaf"]) - 1)]
        together = np.maximum(1, BLOCK_ROWS // np.maximum(1, DEAL_ROWS * share)).astype(np.int64)
        slot = rows.column("part").to_numpy() // together
        columns = [*(rows.column(c) for c in names), pa.array(cell), pa.array(slot), noted]
        return pa.table(columns, names=[*names, "cell", "slot", "visits"])

    return deal


def dealt_once(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, fitted): every row of ``classes`` once, in its own ``cell``, with the cells of lower numbers that it visits.

    If x has its cell at centroid c and y, within the threshold of x, at centroid h, then y's distance to the plane
    between c and h is at most the distance of x and y, the root of 2 - 2 * threshold. So y visits c. Of two cells that
    part at a level, the rows of the higher one that visit the lower one's digit there are compared with all of its rows.
    ``visits`` has (cell with all digits below that level 0) * LEVELS + level. ``slot`` deals the rows of a cell to units of
    about ``BLOCK_ROWS``; ``alone`` says that a label has no cells.
    """
    rows = classes.select("label", F.size("embedding").alias("dims"), "node", "n", "embedding")
    fitted = fit_cells(rows, threshold)
    sizes = fitted.select(*KEYS, F.col("n").alias("size"))
    part = F.pmod(F.xxhash64(F.lit("deal"), "node"), F.ceil(F.col("size") / F.lit(DEAL_ROWS))).alias("part")
    parts = rows.join(sizes, KEYS).select(*rows.columns, part)
    given = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(DEAL_ROWS)).cast("long") - 1)))
    by, given = [*KEYS, "part"], given.drop("n", "depth")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("cell long, slot long, visits array<long>").fields])
    dealt = parts.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(_dealer(threshold), schema)
    none = F.array().cast("array<long>").alias("visits")
    rest = rows.join(sizes, KEYS, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("slot"), none)
    return dealt.withColumn("alone", F.lit(False)).unionByName(rest.withColumn("alone", F.lit(True))), fitted


def cells(classes: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(rows, levels): who takes part in which cell, at ``home`` (1) or as a visitor (0), and how often cells were dealt."""
    dealt, fitted = dealt_once(classes, threshold)
    visitors = dealt.select(*KEYS, F.explode("visits").alias("tag"), "node", "n", F.lit(0).alias("home"))
    visitors = visitors.select(*KEYS, F.floor(F.col("tag") / F.lit(LEVELS)).alias("cell"), "node", "n", "home")
    return dealt.select(*KEYS, "cell", "node", "n", F.lit(1).alias("home")).unionByName(visitors), fitted.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


BLOCK = "label long, dims int, cell long, tags array<long>, visits array<long>, node binary, n binary, embedding binary, visitor binary, visited binary"


def packed(dealt: DataFrame) -> DataFrame:
    """Blocks of ``BLOCK_ROWS`` rows of a cell at most, one row each: ``tags`` are the cell's own at every level, ``visits`` what
    any of the rows visits; ``visitor`` and ``visited`` are the rows' numbers in the block and what each of them visits."""
    kind = dealt.schema["embedding"].dataType.elementType

    def pack(rows: pa.Table) -> Iterator[dict]:
        values = {c: rows.column(c).to_numpy() for c in ("node", "n")}
        label, dims, cell = (rows.column(c)[0].as_py() for c in (*KEYS, "cell"))
        values["embedding"] = rows.column("embedding").combine_chunks().flatten().to_numpy()
        lists = rows.column("visits").combine_chunks()
        visitor = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        visited = lists.flatten().to_numpy()
        tags = [(cell // _step(level) * _step(level)) * LEVELS + level for level in range(LEVELS)]
        for at in range(0, len(lists), BLOCK_ROWS):
            end = min(at + BLOCK_ROWS, len(lists))
            some = (visitor >= at) & (visitor < end)
            yield {
                "label": label, "dims": dims, "cell": cell, "tags": tags, "visits": np.unique(visited[some]), "node": values["node"][at:end].tobytes(),
                "n": values["n"][at:end].tobytes(), "embedding": values["embedding"][at * dims : end * dims].tobytes(),
                "visitor": (visitor[some] - at).tobytes(), "visited": visited[some].tobytes(), "alone": bool(rows.column("alone")[0].as_py() and len(lists) <= BLOCK_ROWS),
            }

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.bool_()]
    schema = pa.schema(list(zip([*(x.split()[0] for x in BLOCK.split(", ")), "alone"], kinds, strict=True)))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, limits in complete_units(batches, UNIT):
            found = [x for begin, end in zip(limits[:-1], limits[1:], strict=True) for x in pack(rows.slice(int(begin), int(end - begin)))]
            for at in range(0, len(found), 64):
                yield pa.RecordBatch.from_pylist(found[at : at + 64], schema=schema)

    units = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)
    blocks = units.mapInArrow(batches_of, f"{BLOCK}, alone boolean").withColumn("id", F.monotonically_increasing_id())
    return stored(blocks.withColumn("kind", F.lit(kind.simpleString())), "blocks", "alone")


def compare(blocks: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): with v null, n rows are linked to class u; else an edge to the centre of a tree of links of two blocks.

    Blocks are compared with themselves where they lie. Pairs of blocks come from the product of the stored table with
    itself: each task reads two of its partitions, and only pairs of one label that may have links leave the JVM.
    """
    columns = ["cell", "dims", "kind", "id", "node", "n", "embedding", "visitor", "visited"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, "", i)
                yield _links(block, block, threshold)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for i in range(batch.num_rows):
                if left is None or left.id != batch.column("a_id")[i].as_py():
                    left = _Block(batch, "a_", i)
                yield _links(left, _Block(batch, "b_", i), threshold)

    several = blocks.filter(~F.col("alone"))
    a, b = several.alias("a"), several.alias("b")
    col = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    (la, lb), (da, db), (ia, ib), (ca, cb), (ta, tb), (va, vb) = map(col, ("label", "dims", "id", "cell", "tags", "visits"))
    # Each two blocks once, half of them the other way round, so that no partition has all pairs of its blocks.
    once = (ia != ib) & ((ia < ib) == ((ia + ib) % 2 == 0))
    meet = ca == cb
    for level in range(LEVELS):
        meet = meet | F.array_contains(vb, ta[level]) | F.array_contains(va, tb[level])
    pairs = a.join(b.hint("shuffle_replicate_nl"), (la == lb) & (da == db) & once & meet)
    pairs = pairs.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in columns])
    schema = "u long, v long, n long"
    return blocks.select(*columns).mapInArrow(inside, schema).unionByName(pairs.mapInArrow(across, schema))


class _Block:
    """A packed block of a batch."""

    def __init__(self, batch: pa.RecordBatch, side: str, i: int) -> None:
        value = lambda c: batch.column(side + c)[i]
        numbers = lambda c: np.frombuffer(value(c).as_py(), np.int64)
        self.id, self.cell = value("id").as_py(), value("cell").as_py()
        self.node, self.n, self.visitor, self.visited = map(numbers, ("node", "n", "visitor", "visited"))
        given = np.frombuffer(value("embedding").as_py(), np.float32 if value("kind").as_py() == "float" else np.float64)
        self.vectors = unit_vectors(given.astype(np.float64).reshape(-1, value("dims").as_py()))

    def visitors(self, cell: int) -> np.ndarray:
        """The rows that are compared with a block of that cell."""
        if self.cell <= cell:
            return np.arange(len(self.node))
        level = next(x for x in range(LEVELS) if self.cell // _step(x) != cell // _step(x))
        return self.visitor[self.visited == (cell // _step(level) * _step(level)) * LEVELS + level]


def _links(a: _Block, b: _Block, threshold: float) -> pa.RecordBatch:
    same = a is b
    left, right = a.visitors(b.cell), b.visitors(a.cell)
    node, count = (a.node, a.n) if same else (np.concatenate([a.node, b.node]), np.concatenate([a.n, b.n]))
    linked = np.zeros(len(node), np.int64)
    forest = Forest(len(node))
    vectors = b.vectors[right]
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        x, y = np.nonzero(a.vectors[some] @ vectors.T >= threshold)
        x, y = some[x], right[y] if same else right[y] + len(a.node)
        x, y = x[x < y], y[x < y]
        if len(x):
            linked += np.bincount(x, count[y], len(node)).astype(np.int64) + np.bincount(y, count[x], len(node)).astype(np.int64)
            forest.link(x, y)
    touched = np.flatnonzero(linked)
    u, v = forest.stars(node) if len(touched) else (node[:0], node[:0])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([node[touched], u])),
            pa.concat_arrays([pa.nulls(len(touched), pa.int64()), pa.array(v)]),
            pa.concat_arrays([pa.array(linked[touched]), pa.nulls(len(u), pa.int64())]),
        ],
        ["u", "v", "n"],
    )


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows with equal labels (not null) are linked at a cosine of ``threshold`` or more. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without a vec_id, link with nothing; vectors of different length do not
    link either. n_links counts other rows, repeated rows included; component_id is the least vec_id reachable; kept
    marks it. Rows that share a vec_id share a component. Other columns are ignored, an empty table gives no row.
    """
    rows, classes = representatives(vectors)
    found = stored(compare(packed(dealt_once(classes, threshold)[0]), threshold), "links")
    counts = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("others"))
    named = components(found.filter("v IS NOT NULL").select("u", "v"))
    equal = ["label", "h1", "h2"]
    full = classes.select(*equal, "node", "n").join(counts, F.col("node") == F.col("u"), "left")
    full = full.select(*equal, "node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    full = full.join(named, "node", "left").select(*equal, "n_links", F.coalesce("component", "node").alias("component_id"))
    linked = rows.join(full, equal).select("vec_id", "n_links", "component_id")
    rest = vectors.filter(~linkable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"),
    )
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
