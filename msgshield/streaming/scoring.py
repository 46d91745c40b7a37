"""Scoring of streams with the same expressions as the batch jobs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import score_messages, score_qr, score_urls

SCORERS = {"messages": score_messages, "urls": score_urls, "qr": score_qr}


def stream_score(df: DataFrame, kind: str, column: str, model: PipelineModel | None = None) -> DataFrame:
    """Score a streaming (or static) frame: ``kind`` is messages, urls or qr, ``column`` holds the text."""
    return SCORERS[kind](df, column, model=model)


def write_scores(scored: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scores as Parquet. The file sink commits each batch once, so a restart neither loses nor repeats rows."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
