"""Ordered computations without a global sort: numbering, rank cut-offs, prefix sums.

A window without partition keys would pull the table into one task. Here the order key is cut into digits, from coarse
to fine; totals are summed in order level by level, and rows are ranked inside their own finest bucket. A window holds
no more rows than a digit has values, whatever the distribution of the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a digit of an integer key.
DIGIT_BITS = 16


def shuffle_key(seed: int, key: Column) -> Column:
    """A reproducible random order: the same on any number of partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(digest: Column) -> Column:
    """Order-preserving bucket of a hex digest: 65,536 buckets of equal expected size."""
    return F.substring(digest, 1, 4)


def hash_digits(digest: Column) -> list[Column]:
    """The digits that order a hex digest: one, since digests are evenly spread."""
    return [hash_bucket(digest)]


def integer_digits(value: Column, bits: int = DIGIT_BITS) -> list[Column]:
    """The digits that order a unique integer: below each lie at most ``2 ** bits`` values of the next, and below the last as
    many rows."""
    value = value.cast("long")
    return [F.shiftright(value, shift) for shift in range(bits * ((63 // bits)), 0, -bits)]


def running_totals(totals: DataFrame, keys: list[str], digits: list[str], values: list[str]) -> DataFrame:
    """``totals`` (one row per key and digits) with ``<value>_before``: the sum over smaller digits of the same key."""
    earlier = Window.partitionBy(*(keys + digits[:-1] or [F.lit(0)])).orderBy(digits[-1])
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select(
        *keys, *digits, *values, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values]
    )
    if len(digits) == 1:
        return inner
    upper = totals.groupBy(*keys, *digits[:-1]).agg(*[F.sum(v).alias(v) for v in values])
    upper = running_totals(upper, keys, digits[:-1], values).select(
        *keys, *digits[:-1], *[F.col(f"{v}_before").alias(f"{v}_above") for v in values]
    )
    return inner.join(upper, keys + digits[:-1]).select(
        *keys, *digits, *values, *[(F.col(f"{v}_before") + F.col(f"{v}_above")).alias(f"{v}_before") for v in values]
    )


def sequential_id(df: DataFrame, order: str, output: str, start: int = 0, bits: int = DIGIT_BITS) -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique integer column.

    Every bucket of its finest digit gets an offset; a row adds its rank inside the bucket, which holds at most
    ``2 ** bits`` rows because the order column is unique.
    """
    columns = integer_digits(F.col(order), bits)
    digits = [f"__digit{i}" for i in range(len(columns))]
    rows = df.withColumns(dict(zip(digits, columns, strict=True)))
    # The finest digit holds the ones above it, so it names a bucket by itself.
    totals = rows.groupBy(*digits).agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_totals(totals, [], digits, ["__n"]).select(digits[-1], "__n_before")
    rank = F.row_number().over(Window.partitionBy(digits[-1]).orderBy(order))
    number = F.col("__n_before") + F.col("__rank") + F.lit(start - 1)
    ranked = rows.drop(*digits[:-1]).withColumn("__rank", rank)
    return ranked.join(offsets, digits[-1]).withColumn(output, number.cast("long")).select(*df.columns, output)


def formatted_id(prefix: str, number: Column) -> Column:
    """``MSG_000042``; numbers beyond six digits keep all of them."""
    return F.format_string(f"{prefix}_%06d", number)


def rank_cutoffs(
    units: DataFrame,
    strata: list[str],
    order: str,
    ranks: dict[str, Callable[[Column], Column]],
    digits: Callable[[Column], list[Column]] = hash_digits,
) -> DataFrame:
    """Per stratum the order key of its k-th unit, for every named rank; null where k is 0.

    ``ranks`` maps a name to k as a function of the stratum's size. Afterwards a row belongs to the first k of its
    stratum exactly if its key is at most the cut-off, which needs no shuffle of the rows. ``order`` must be unique
    per stratum, and strata are combinations of a few categories. Three steps: totals per bucket, the bucket that holds
    rank k, the rank inside that bucket only. The buckets found are broadcast: one for each stratum and rank.
    """
    keys = strata or ["__all"]
    units = units.select(*strata, F.col(order).alias("__order"), *([] if strata else [F.lit(0).alias("__all")]))
    columns = digits(F.col("__order"))
    names = [f"__digit{i}" for i in range(len(columns))]
    units = units.withColumns(dict(zip(names, columns, strict=True)))
    totals = units.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    sizes = totals.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    totals = running_totals(totals, keys, names, ["__n"]).join(F.broadcast(sizes), keys)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank(F.col("__size")).cast("long").alias("k")) for name, rank in ranks.items()]
    )
    targets = totals.select("*", F.inline(wanted))
    hits = targets.filter((F.col("k") > F.col("__n_before")) & (F.col("k") <= F.col("__n_before") + F.col("__n")))
    hits = hits.select(*keys, names[-1], "name", (F.col("k") - F.col("__n_before")).alias("__offset"))
    inside = units.select(*keys, names[-1], "__order").join(F.broadcast(hits), [*keys, names[-1]])
    rank = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("__order"))
    found = inside.withColumn("__rank", rank).filter(F.col("__rank") == F.col("__offset"))
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("__order"))).alias(name) for name in ranks]
    )
    return wide if strata else wide.drop("__all")


def weight_cutoff(rows: DataFrame, digest: str, fraction: float) -> tuple[str | None, int, int]:
    """Take units in digest order while the rows taken before a unit are fewer than ``int(fraction * rows)``.

    Returns the digest of the last unit taken (None if there is none), the number of rows and of rows taken. A unit
    is a distinct digest, its weight the rows that carry it; units are only formed inside the one bucket where the
    sum is reached.
    """
    rows = rows.select(F.col(digest).alias("__digest")).withColumn("__bucket", hash_bucket(F.col("__digest")))
    totals = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows whatever the data size.
    buckets = sorted((r["__bucket"], r["n"]) for r in totals.collect())
    total = sum(n for _, n in buckets)
    target = int(total * fraction)
    before = 0
    for name, n in buckets:
        if before + n >= target > before:
            units = rows.filter(F.col("__bucket") == name).groupBy("__digest").agg(F.count(F.lit(1)).alias("n"))
            running = F.sum("n").over(
                Window.partitionBy(F.lit(0)).orderBy("__digest").rowsBetween(Window.unboundedPreceding, -1)
            )
            taken = units.withColumn("before", F.coalesce(running, F.lit(0)) + before).filter(F.col("before") < target)
            last, weight = taken.agg(F.max("__digest"), F.sum("n")).first()
            return last, total, before + weight
        before += n
    return None, total, 0


def prefix_sums(
    df: DataFrame, groups: list[str], order: str, values: list[str], buckets: int | None = None
) -> DataFrame:
    """Add ``<value>_before``: the sum over smaller ``order`` keys of the same group. ``order`` is unique per group.

    The key is numeric with any distribution, so the buckets follow its approximate quantiles; by default there are as
    many as shuffle partitions.
    """
    n = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n)))
    splits = [float("-inf"), *bounds, float("inf")]
    if bounds:
        rows = Bucketizer(splits=splits, inputCol=order, outputCol="__bucket").transform(df)
    else:
        rows = df.withColumn("__bucket", F.lit(0.0))
    before = (Window.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, "__bucket").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    by_bucket = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__bucket").rowsBetween(*before)
    totals = totals.select(
        *groups, "__bucket", *[F.coalesce(F.sum(f"__{v}").over(by_bucket), F.lit(0)).alias(f"__{v}") for v in values]
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(order).rowsBetween(*before)
    rows = rows.withColumns({f"__{v}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    rows = rows.join(totals, [*groups, "__bucket"])
    return rows.select(*df.columns, *[(F.col(f"__{v}_in") + F.col(f"__{v}")).alias(f"{v}_before") for v in values])
