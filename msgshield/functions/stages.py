"""Chains of projections that are described once and applied to many frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame

Stages = list[dict[str, Column]]


def apply_stages(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def once(build: Callable) -> Callable:
    """Keep the result of an expression builder. Expressions refer to columns by name only, and building a long list
    of them costs the driver more than a thousand calls into the JVM."""
    kept: dict = {}

    @wraps(build)
    def get(*args):
        gateway = SparkContext._gateway
        key = (id(gateway), args)
        if key not in kept:
            kept[key] = (gateway, build(*args))
        return kept[key][1]

    return get
