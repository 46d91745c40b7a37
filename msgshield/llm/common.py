"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# White space as the contracts of the operators define it: blank and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables, as it lies."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, lost executors lose nothing.

    ``by`` are columns that get folders of their own, so that a filter on them skips the files of other values.
    """
    path = shared_dir(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 20_000


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow ``table``, marked for broadcast if it has at most ``rows`` rows; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= rows else table


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` (a narrow stored table) in total order with ``at``: 0, 1, 2, ...; equal rows lie side by side.

    Range partitions hold consecutive rows, so a row's number is its place in the partition and the rows of the
    partitions before; the broadcast table has one row for each partition. The place in the input is the last key, so
    a hot key is cut like any other rows. The result is stored.
    """
    keys = [*order, F.col("__row")]
    kept = rows.columns
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(rows.select(*kept, F.spark_partition_id().alias("__part"), place.alias("__place")), name)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = (F.col("__before") + F.col("__place")).alias("at")
    return placed.join(F.broadcast(parts), "__part").select(*kept, at)


class Shared:
    """A value of bounded size for the tasks. It travels with the code of its class, like the functions that read it."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self) -> object:
        return cloudpickle.loads(self.data.value)


class StoredBytes:
    """One value of bounded size that a job made, for the tasks of later jobs, which read it from the shared folder.

    It does not pass the driver unless pyarrow has no access to the file system of that folder.
    """

    def __init__(self, value: DataFrame, name: str) -> None:
        """``value``: at most one row with one binary column."""
        self.path = shared_dir(value.sparkSession, name)
        value.toDF("value").write.parquet(self.path)
        self.shared = None
        try:
            self._files()
        except (OSError, pa.ArrowException):
            rows = value.sparkSession.read.schema("value binary").parquet(self.path).collect()
            self.shared = Shared(value.sparkSession, [bytes(r["value"]) for r in rows])

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, path = fs.FileSystem.from_uri(self.path)
        return system, [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")]

    def empty(self) -> bool:
        if self.shared is not None:
            return not self.shared.load()
        system, files = self._files()
        return not any(pq.read_metadata(f, filesystem=system).num_rows for f in files)

    def load(self) -> bytes:
        if self.shared is not None:
            return self.shared.load()[0]
        system, files = self._files()
        return next(rows[0] for f in files if (rows := pq.read_table(f, filesystem=system).column("value").to_pylist()))


def text_key(value: Column) -> Column:
    """A value as a string that keeps null apart from every text, for joins and hashes."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit("-"))


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offsets(totals: DataFrame, keys: Sequence[str], levels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``before_<value>``: the sum of the values of all earlier rows of the key, in the order of ``levels``.

    ``totals`` has one row for each key and combination of levels. The sums run level by level, so that a window
    never holds more rows than a level has values below one value of the level above.
    """
    keys, levels, values = list(keys), list(levels), list(values)
    earlier = Window.partitionBy(*keys, *levels[:-1]).orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select(
        *keys, *levels, *values, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"before_{v}") for v in values]
    )
    if len(levels) == 1:
        return inner
    upper = totals.groupBy(*keys, *levels[:-1]).agg(*[F.sum(v).alias(v) for v in values])
    upper = offsets(upper, keys, levels[:-1], values).select(
        *keys, *levels[:-1], *[F.col(f"before_{v}").alias(f"above_{v}") for v in values]
    )
    return inner.join(upper, [*keys, *levels[:-1]]).select(
        *keys, *levels, *values, *[(F.col(f"before_{v}") + F.col(f"above_{v}")).alias(f"before_{v}") for v in values]
    )
