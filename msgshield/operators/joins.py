"""Membership and lookup joins.

They are plain joins: adaptive execution broadcasts a side that turns out small and splits the partition of a key that
holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import EXTERNAL_LABELS

def by_digest(col: Column) -> Column:
    """Join key of a long text. Declared never null: a join would otherwise test the whole expression for null, and
    so compute it twice."""
    return F.coalesce(F.sha2(F.coalesce(col, F.lit("")), 256), F.lit(""))


def exclude_known(external: DataFrame, master: DataFrame, text: str) -> DataFrame:
    """Rows whose text is not among the master's texts. Compared by digest, so no text is shuffled as a key."""
    known = master.select(by_digest(F.col(text)).alias("__digest")).distinct()
    rows = external.withColumn("__digest", by_digest(F.col(text)))
    return rows.join(known, "__digest", "left_anti").drop("__digest")


def store_digests(master: DataFrame, text: str, table: str, path: str, buckets: int = 64) -> None:
    """The digests of the master's texts as a table in buckets, for joins with one batch after another.

    ``path`` is a folder of its own; another application opens it with ``open_digests``.
    """
    known = master.select(by_digest(F.col(text)).alias("digest")).distinct()
    known.write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).mode("overwrite").saveAsTable(table)


def open_digests(spark: SparkSession, table: str, path: str, buckets: int = 64) -> None:
    """Name a table that ``store_digests`` wrote in another application."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (digest STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )


def exclude_stored(external: DataFrame, table: str, text: str) -> DataFrame:
    """Rows whose text is not among those of ``store_digests``. Only the batch is dealt out; the table lies in its buckets."""
    rows = external.withColumn("__digest", by_digest(F.col(text)))
    known = external.sparkSession.table(table).withColumnRenamed("digest", "__known")
    return rows.join(known, F.col("__digest") == F.col("__known"), "left_anti").drop("__digest")


def members(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``table``."""
    return rows.join(table.select(key).distinct(), key, "left_semi")


def non_members(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``table``; copies stay."""
    return rows.join(table.select(key).distinct(), key, "left_anti")


def map_external_label(df: DataFrame) -> DataFrame:
    """Binary label from ``final_label``, else ``label``; rows with an unknown label are dropped."""
    source = next((c for c in ("final_label", "label") if c in df.columns), None)
    if source is None:
        raise ValueError("neither 'final_label' nor 'label' is a column")
    name = F.col(source).cast("string")
    mapped = None
    for value, label in EXTERNAL_LABELS.items():
        mapped = F.when(name == value, label) if mapped is None else mapped.when(name == value, label)
    return df.withColumn("label", mapped.cast("int")).filter(F.col("label").isNotNull())


def leaked_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that occur on both sides; empty if the split holds."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def assert_no_leak(left: DataFrame, right: DataFrame, key: str) -> None:
    if not leaked_keys(left, right, key).isEmpty():
        raise ValueError(f"{key} values occur on both sides of the split")
