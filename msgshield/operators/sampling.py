"""Bounded samples without a global sort: the rows with the smallest hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a hash that one pass looks at, from the highest.
PASS_BITS = 16


def _threshold(rows: DataFrame, hashed: Column, wanted: int) -> tuple[int | None, int]:
    """(t, left): fewer than ``wanted`` rows have a hash below t, ``left`` more are wanted of those with the hash t.

    t is None if there are not more rows than wanted. Every pass counts the rows by the next 16 bits of the hash, among those
    that agree so far, so at most 65,536 counts reach the driver. It ends early where all rows that agree are wanted.
    """
    rows = rows.select(hashed.alias("__hash"))
    prefix = None
    for shift in range(64 - PASS_BITS, -1, -PASS_BITS):
        totals = rows.groupBy(F.shiftright("__hash", shift).alias("__bits")).agg(F.count(F.lit(1)).alias("n"))
        before = 0
        for bits, n in sorted((r["__bits"], r["n"]) for r in totals.collect()):
            if before + n >= wanted:
                break
            before += n
        else:
            return None, 0
        prefix, wanted = bits, wanted - before
        if n == wanted:
            # The last hash that begins with these bits: all of them are wanted.
            return (prefix << shift) + (1 << shift) - 1, n
        rows = rows.filter(F.shiftright("__hash", shift) == prefix)
    return prefix, wanted


def bottom_rows(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``rows`` rows of ``df``, or all if there are fewer: those with the smallest hash of ``key``.

    Equal keys are told apart by a hash of all columns, then by the columns themselves; rows that agree in everything
    are interchangeable. Nothing is sorted or gathered: the thresholds come from counts, the rows are filtered. ``df``
    is read up to nine times, so it should be stored.
    """
    if rows <= 0:
        return df.limit(0)
    first, second = F.xxhash64(*key), F.xxhash64(F.lit("row"), *df.columns)
    t, left = _threshold(df, first, rows)
    if t is None:
        return df
    tied = df.filter(first == F.lit(t))
    if tied.limit(left + 1).count() <= left:
        return df.filter(first <= F.lit(t))
    below = df.filter(first < F.lit(t))
    u, left = _threshold(tied, second, left)
    below = below.unionByName(tied.filter(second < F.lit(u)))
    # Rows with one hash are copies of one row, but for a collision: counted, numbered in order and written out again.
    copies = tied.filter(second == F.lit(u)).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("__n"), F.lit(left) - F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    copies = copies.withColumn("__taken", taken.cast("int")).filter("__taken > 0")
    copies = copies.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("__taken"))).alias("__copy"))
    return below.unionByName(copies.select(*df.columns))
