"""Filters on computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are costly to compute.

    An ordinary filter is pushed below the projection that computes its columns, which then runs twice: in the filter
    and in the projection. A row counter that the condition reads keeps the filter where it is. Use ``filter`` on
    stored columns, where the push-down is wanted.
    """
    counted = df.withColumn("__row", F.monotonically_increasing_id())
    return counted.filter(condition & (F.col("__row") >= 0)).drop("__row")
