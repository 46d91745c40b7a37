"""Isotonic regression of any number of rows: pools per score range, merged afterwards.

Pooling adjacent violators gives the same pools in whatever order neighbours are merged. So every range of scores is
pooled by itself, in one pass over its rows in order, and only the pools, whose number grows with the cube root of the
rows for labels of 0 and 1, are merged with those of the other ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

POOLS = "low double, high double, total double, weight double"
# Tiers go on while there are more pools than this and a tier still halves them.
FINAL_POOLS = 50_000


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours while the mean does not rise. The stack holds the pools of the range, not its rows."""
    low, high, total, weight = [], [], [], []
    for batch in batches:
        for a, b, t, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while total and total[-1] * w >= t * weight[-1]:
                a = low.pop()
                high.pop()
                t += total.pop()
                w += weight.pop()
            low.append(a)
            high.append(b)
            total.append(t)
            weight.append(w)
    columns = [pa.array(c, pa.float64()) for c in (low, high, total, weight)]
    yield pa.RecordBatch.from_arrays(columns, ["low", "high", "total", "weight"])


def pools(rows: DataFrame, score: Column, label: Column, most: int = FINAL_POOLS) -> DataFrame:
    """low, high, total, weight of score ranges whose mean labels already rise inside each range of scores.

    Rows with a null score or label are left out. Further tiers with fewer ranges merge what is left, until at most ``most`` pools
    remain or a tier no longer halves them.
    """
    points = rows.select(score.cast("double").alias("low"), label.cast("double").alias("__label")).dropna()
    points = points.groupBy("low").agg(F.sum("__label").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    points = points.select("low", F.col("low").alias("high"), "total", "weight")
    ranges = points.repartitionByRange("low")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(ranges.sortWithinPartitions("low").mapInArrow(_pooled, POOLS), "pools")
    count = found.count()
    while count > most and parts > 1:
        parts = -(-parts // 8)
        merged = found.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInArrow(_pooled, POOLS)
        found, before, count = stored(merged, "pools"), count, merged.count()
        if 2 * count > before:
            break
    return found


def fit_isotonic(rows: DataFrame, score: Column, label: Column, most: int = FINAL_POOLS) -> IsotonicRegressionModel:
    """The isotonic regression of ``label`` on ``score`` over all rows, as a model that reads ``probability[1]``.

    A pool enters the last merge, which the driver makes, as its two ends with half of its weight each; that leaves the fit
    unchanged, and the model holds no more than these points anyway. Without rows there is no fit: ValueError.
    """
    found = pools(rows, score, label, most)
    ends = F.array(F.struct(F.col("low").alias("x"), (F.col("weight") / 2).alias("w")), F.struct(F.col("high").alias("x"), (F.col("weight") / 2).alias("w")))
    points = found.select((F.col("total") / F.col("weight")).alias("__y"), F.explode(ends).alias("end"))
    points = points.select("__y", F.col("end.w").alias("__w"), array_to_vector(F.array(1.0 - F.col("end.x"), F.col("end.x"))).alias("probability"))
    if points.isEmpty():
        raise ValueError("no rows with a score and a label")
    isotonic = IsotonicRegression(
        featuresCol="probability", featureIndex=1, labelCol="__y", weightCol="__w", predictionCol="calibrated", isotonic=True
    )
    return isotonic.fit(points)
