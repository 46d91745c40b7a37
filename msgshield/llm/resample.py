"""Resampling towards a target distribution by hashed n-gram importance weights.

Every run of one to three words falls into a bucket by its CRC-32. The share of a bucket in the target texts over its
share in all documents, as a logarithm, is its gain; a document weighs the sum of the gains of its runs. Gumbel noise
from a digest of the doc_id makes the highest scores a draw without replacement in proportion to the weights.

The runs of a piece of a batch are interned in open-addressed tables (``ngrams``). Counting adds the occurrences of a
slot to its bucket; weighing gathers, by the slots of a document's occurrences, the gains of their buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Shared, numbered, stored
from .ngrams import pieces

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
# Drawn: this many of a hundred documents with enough words.
PERCENT = 5


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: the runs of words of all texts by bucket. A task gives at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0), longest):
                for table, crc in zip(piece.tables, piece.crc, strict=True):
                    np.add.at(totals, crc % buckets, table.count)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of every bucket: ``buckets`` numbers, whatever the size of the tables."""
    found = []
    for table in (docs, target):
        counts = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table, buckets, longest).collect():
            counts[r["bucket"]] = r["n"]
        found.append(counts)
    source, aim = found
    all_source, all_aim = float(source.sum() + buckets), float(aim.sum() + buckets)
    ratio = ((aim + 1.0) * all_source) / ((source + 1.0) * all_aim)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, *carry: Column, longest: int = LONGEST) -> DataFrame:
    """The columns ``carry``, n_words, n_features and weight of every row of ``docs``. Null texts have no words."""
    rows = docs.select(*carry, F.col("text").alias("__text"))
    made = [StructField(name, LongType()) for name in ("n_words", "n_features", "weight")]
    schema = StructType([*rows.schema.fields[:-1], *made])
    shared = Shared(docs.sparkSession, gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.load()
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for piece in pieces(batch.column(batch.num_columns - 1), longest):
                words += np.bincount(piece.row[0], minlength=n)
                for row, table, crc in zip(piece.row, piece.tables, piece.crc, strict=True):
                    features += np.bincount(row, minlength=n)
                    of_slot = gain[crc % len(gain)]
                    # Sums of integers below 2 ** 53 are exact in doubles.
                    weight += np.bincount(row, of_slot[table.slot], minlength=n).astype(np.int64)
            columns = [*batch.columns[:-1], *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(weigh, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the first 32 bits of a digest of the key; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text); ``target``: text.

    Drawn are ``percent`` of a hundred of the rows with at least ``least_words`` words, rounded down, by falling score;
    ties go to the smaller doc_id, then to the row with the smaller weight, null doc_ids last. The others have a null
    rank. Null and empty texts have no features and weight 0. Rows that repeat a doc_id are rows of their own with the
    same noise. Empty targets make all gains follow from the documents alone; an empty ``docs`` gives no row.
    """
    found = weights(docs, gains(docs, target), F.col("doc_id").cast("long").alias("doc_id"))
    found = stored(found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "weighed")
    enough = F.col("n_words") >= least_words
    drawn = found.filter(enough).count() * percent // 100
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features"]
    rank = F.when(enough & (F.col("at") < drawn), F.col("at") + 1)
    return numbered(found, order, "ranked").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The resampled documents themselves: the rows of ``docs`` with a rank. ``docs`` has one row for each doc_id."""
    ranks = resample(docs, target, percent, least_words).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__id"))
    return docs.join(ranks, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
