"""Keep-first deduplication and template clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import template_skeleton
from ..session import stored
from .joins import by_digest
from .ordering import sequential_id


def first_ordinals(df: DataFrame, key: str, order: str) -> DataFrame:
    """The least ``order`` of every key, as a column ``order``.

    A hash aggregate of digests and numbers: each map task reduces the copies it sees to one before the shuffle, so a
    key that holds a large share of the table costs no task more than one row per map task.
    """
    return df.groupBy(F.sha2(F.col(key), 256).alias("__key")).agg(F.min(order).alias(order)).select(order)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the least ``order``, a unique number.

    The winners are found in a narrow table; the wide rows are met again in a join on the unique number, where no key
    can be hot. The rows are read twice: pass a stored table if they are costly.
    """
    return df.join(first_ordinals(df, key, order), order, "left_semi")


def keep_first_numbered(df: DataFrame, key: str, ordinal: str, output: str, start: int = 1) -> DataFrame:
    """Keep the first row per key and number the kept rows 1, 2, 3, ... in ordinal order.

    The winners are found and numbered as a narrow table of digests and ordinals. The wide rows move once, in a join
    on the unique ordinal, where no key can be hot.
    """
    winners = sequential_id(first_ordinals(df, key, ordinal), ordinal, output, start)
    return df.join(winners, ordinal).select(*df.columns, output)


def template_stats(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per template: digest, dense id in first-seen order, row count, highest label, channel of the first row.

    Expects ``template_skeleton``, ``label`` and ``channel``. The skeletons themselves are not moved.
    """
    stats = df.groupBy(by_digest(F.col("template_skeleton")).alias("template_digest")).agg(
        F.min(ordinal).alias("first_ordinal"),
        F.count("label").alias("size"),
        F.max("label").alias("label"),
        F.min_by("channel", ordinal).alias("channel"),
    )
    return sequential_id(stats, "first_ordinal", "template_id")


def template_ids(df: DataFrame, skeleton: str = "template_skeleton", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, template_id): equal skeletons share a dense id in first-seen order.

    Works on a stored narrow table of ordinals and digests, so the skeletons are computed once. Templates are joined
    back by digest.
    """
    narrow = stored(df.select(ordinal, by_digest(F.col(skeleton)).alias("__digest")), "template-digests")
    first = narrow.groupBy("__digest").agg(F.min(ordinal).alias("__first"))
    ids = sequential_id(first, "__first", "template_id").select("__digest", "template_id")
    return narrow.join(ids, "__digest").select(ordinal, "template_id")


def cluster_templates(df: DataFrame, text: str = "cleaned_text", ordinal: str = "ordinal") -> DataFrame:
    """Add ``template_skeleton`` and ``template_id``; the join back is on the unique ordinal."""
    rows = df.withColumn("template_skeleton", template_skeleton(F.col(text)))
    return rows.join(template_ids(rows, "template_skeleton", ordinal), ordinal)
