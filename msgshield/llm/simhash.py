"""SimHash fingerprints and their near-duplicates by pivot distance tables.

Fingerprint: the majority bits of the XXH64 of all 3-word shingles. Documents with one fingerprint are one
representative from the start. Representatives that can lie within three bits share two of five bit fields (three
changed bits spoil at most three fields), which deals them to ten sets of groups. In a group every fingerprint has a row of
Hamming distances to reference fingerprints (pivots); by the triangle inequality a pair whose rows differ by more than
three in any column is discarded, and the survivors are verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored, text_key
from .components import components
from .pairs import Forest, block_pairs, by_unit, complete_units, unit_columns
from .words import slices

SHINGLE = 3
SEED = 42
BITS = 3
PIVOTS = 16
BLOCK_ROWS = 2048
SMALL_UNIT = 16
KEYS = ["kind", "bits"]
# Nodes of prints that no row with a doc_id has lie from here on.
NAMELESS = 1 << 62
# Five fields of 13, 13, 13, 13 and 12 bits.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every run of three words, repeats included; fewer words: of all of them; none: no hash."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(sizes)
    start = (end - sizes)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(line[a:b], SEED) for a, b in zip(start, (end[SHINGLE - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64
    )


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; 0 for none."""
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        piece = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.zeros(len(texts), dtype=np.uint64)
        for row, piece in slices(texts):
            for i, text in enumerate(piece.cast(pa.binary()).to_pylist()):
                prints[row + i] = majority(shingle_hashes(text or b""))
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*names, "print"])


def fingerprints(docs: DataFrame, *carry: Column) -> DataFrame:
    """The columns ``carry`` and ``print`` (64 bits as a signed long) of every row. Null and empty texts have print 0."""
    rows = docs.select(*carry, F.col("text").alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("print", LongType())])
    return rows.mapInArrow(_fingerprint_batches, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: random ones, since the distances to them are nearly independent."""
    return np.random.default_rng(7).integers(0, 2**64, n, dtype=np.uint64)


def _near(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pivot discards and that differ in at most three bits."""
    for column in range(PIVOTS):
        keep = np.abs(table[a, column] - table[b, column]) <= BITS
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(prints[a] ^ prints[b]) <= BITS
    return a[keep], b[keep]


def _large_unit(prints: np.ndarray, table: np.ndarray, own: np.ndarray, i: int, j: int) -> Forest:
    """The links of one unit."""
    left = np.arange(len(prints)) if i == j else np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    # Both sides in the order of the first pivot: the partners of a few rows are then one run.
    left, right = left[np.argsort(table[left, 0], kind="stable")], right[np.argsort(table[right, 0], kind="stable")]
    lo = np.searchsorted(table[right, 0], table[left, 0] - BITS, side="left")
    hi = np.searchsorted(table[right, 0], table[left, 0] + BITS, side="right")
    forest = Forest(len(prints))
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        partners = right[lo[at] : hi[min(at + 128, len(left)) - 1]]
        a, b = (x.ravel() for x in np.meshgrid(rows, partners, indexing="ij"))
        if i == j:
            a, b = a[a < b], b[a < b]
        forest.link(*_near(prints, table, a, b))
    return forest


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the units. Small units are compared all at once, by the distance of rows in the batch."""
    references = pivots()
    for rows, limits in complete_units(batches, unit_columns(KEYS)):
        node = rows.column("node").to_numpy()
        prints = rows.column("print").to_numpy().view(np.uint64)
        table = np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)
        own, i, j = (rows.column(c).to_numpy() for c in ("__own", "__i", "__j"))
        sizes = np.diff(limits)
        u, v = [], []
        end = np.repeat(np.where(sizes <= SMALL_UNIT, limits[1:], 0), sizes)
        index = np.arange(len(prints))
        for shift in range(1, SMALL_UNIT):
            a = index[index + shift < end]
            b = a + shift
            apart = (i[a] == j[a]) | (own[a] != own[b])
            a, b = _near(prints, table, a[apart], b[apart])
            u.append(node[a])
            v.append(node[b])
        for k in np.flatnonzero(sizes > SMALL_UNIT):
            unit = slice(limits[k], limits[k + 1])
            stars = _large_unit(prints[unit], table[unit], own[unit], i[limits[k]], j[limits[k]]).stars(node[unit])
            u.append(stars[0])
            v.append(stars[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """``prints`` (print: distinct, node) -> edges (u, v), some repeated, of nodes that connect the same as all pairs within three bits do."""
    fields = [F.shiftright("print", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in FIELDS]
    keys = [
        F.struct(F.lit(5 * i + j).cast("long").alias("kind"), (fields[i] * F.lit(1 << 13) + fields[j]).cast("long").alias("bits"))
        for i in range(5)
        for j in range(i + 1, 5)
    ]
    dealt = prints.select("print", "node", F.explode(F.array(*keys)).alias("key")).select("print", "node", "key.kind", "key.bits")
    units = by_unit(block_pairs(dealt, KEYS, "print", BLOCK_ROWS), KEYS)
    return units.mapInArrow(_edge_batches, "u long, v long")


def _with_component(prints: DataFrame) -> DataFrame:
    """``prints`` with ``component``: the least doc_id reachable; a number from NAMELESS on where no row has a doc_id.

    A print's node is the least doc_id that has it, so the least node of a component is its name already.
    """
    nameless = F.col("print").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.select("print", F.coalesce("least", nameless).alias("node")), "classes")
    named = classes.join(components(links(classes)).withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    return prints.join(named.select("print", F.coalesce("component", "node").alias("component")), "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable, the row's own included.

    A row for every row of ``docs``; of its columns only doc_id (below 2 ** 62) and text are read. Null and empty texts
    have fingerprint zero and are linked like any other. Rows that repeat a doc_id each follow their own text. A
    component in which all doc_ids are null has a null component_id. An empty table gives no row.
    """
    prints = stored(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")), "prints")
    name = F.when(F.col("component") < NAMELESS, F.col("component"))
    return _with_component(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), name.alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every component: the row whose doc_id names it.

    If rows with different texts share that doc_id, each of the texts stays; of rows that agree in doc_id and text the
    one with the least hash of its columns stays. Of a component without doc_ids the row with the least hash of its text stays.
    """
    digest = F.xxhash64(text_key(F.col("text")))
    prints = stored(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")), "prints")
    marked = stored(_with_component(prints).select("doc_id", "digest", "component"), "marked")
    counted = F.count(F.lit(1)).alias("n")
    named = marked.filter(F.col("doc_id") == F.col("component")).groupBy("doc_id", "digest").agg(counted)
    nameless = marked.filter(F.col("component") >= NAMELESS).groupBy("component", "digest").agg(counted)
    nameless = nameless.groupBy("component").agg(F.min(F.struct("digest", "n")).alias("first"))
    nameless = nameless.select(F.lit(None).cast("long").alias("doc_id"), "first.digest", "first.n")
    kept = named.unionByName(nameless).select(text_key(F.col("doc_id")).alias("__id"), F.col("digest").alias("__digest"), "n")
    kept = stored(kept, "kept")
    rows = docs.withColumn("__id", text_key(F.col("doc_id").cast("long"))).withColumn("__digest", digest)
    single = rows.join(kept.filter("n = 1"), ["__id", "__digest"], "left_semi").select(*docs.columns)
    # Rows that repeat doc_id and text: the one with the least hash of all its columns, on any run.
    repeated = rows.join(kept.filter("n > 1"), ["__id", "__digest"], "left_semi")
    least = F.min(F.struct(F.xxhash64(*docs.columns).alias("__hash"), *[F.col(c) for c in docs.columns])).alias("__row")
    repeated = repeated.groupBy("__id", "__digest").agg(least).select("__row.*")
    return single.unionByName(repeated.select(*docs.columns))
