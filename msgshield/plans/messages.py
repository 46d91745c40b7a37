"""Message jobs: clean corpus, leak-free splits, external holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import strip
from ..functions.fixed import CLEAN_COLUMNS
from ..functions.text import clean_text, label_name, purge_reason, template_skeleton, with_channel, with_message_stats
from ..operators.dedup import keep_first, keep_first_numbered
from ..operators.filters import filter_computed
from ..operators.joins import assert_no_leak, by_digest, exclude_known, map_external_label
from ..operators.ordering import formatted_id
from ..operators.quality import purge_counts, quality_audit
from ..operators.splits import split_templates
from ..session import stored
from ..sources.readers import read_csv_table, read_messages_json
from ..sources.writers import write_by_channel


def tag_messages(raw: DataFrame) -> DataFrame:
    """Binary-labelled messages (ordinal, text, label) with cleaned text and the reason to purge them, if any."""
    rows = raw.filter(F.col("label").isin(0, 1)).withColumn("raw_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("cleaned_text", clean_text(F.col("raw_text")))
    rows = rows.withColumn("purge_reason", purge_reason(F.col("raw_text"), F.col("cleaned_text")))
    return rows.select("ordinal", "label", "raw_text", "cleaned_text", "purge_reason")


def kept_messages(raw: DataFrame) -> DataFrame:
    return filter_computed(tag_messages(raw), F.col("purge_reason").isNull()).drop("purge_reason")


def _number_and_measure(kept: DataFrame) -> DataFrame:
    # Statistics depend on the cleaned text only, so they are computed after copies are gone.
    rows = keep_first_numbered(kept, "cleaned_text", "ordinal", "__number")
    rows = with_message_stats(with_channel(rows))
    rows = rows.withColumns(
        {"message_id": formatted_id("MSG", F.col("__number")), "label_name": label_name(F.col("label"))}
    )
    return rows.select(*CLEAN_COLUMNS, "ordinal")


def clean_messages(raw: DataFrame) -> DataFrame:
    """The clean corpus of (ordinal, text, label): 14 columns plus ``ordinal``.

    The cleaned rows are stored once: both passes of the deduplication read them, and neither cleans again.
    """
    return _number_and_measure(stored(kept_messages(raw), "kept"))


def build_clean_messages(spark: SparkSession, path: str, out: str, lines: bool = False) -> dict[str, DataFrame]:
    """Read raw messages, write the clean corpus by channel, return purge counts and the quality audit."""
    tagged = stored(tag_messages(read_messages_json(spark, path, lines)), "tagged")
    clean = _number_and_measure(tagged.filter(F.col("purge_reason").isNull())).select(CLEAN_COLUMNS)
    write_by_channel(clean, out)
    return {"purge_counts": purge_counts(tagged), "audit": quality_audit(read_csv_table(spark, out, clean.schema))}


def message_splits(clean: DataFrame) -> DataFrame:
    """Clean messages with ``split``: train, validation, test_a (stratified), test_b (unseen templates).

    A row's place depends on its text, which is unique here, and not on its position in the input. No template lies on
    both sides of the split; that is checked where the splits are written.
    """
    rows = clean.withColumn("template_skeleton", template_skeleton(F.col("cleaned_text")))
    rows = rows.withColumn("__text_digest", by_digest(F.col("cleaned_text")))
    return split_templates(rows, "template_skeleton", "__text_digest").drop("__text_digest")


def write_message_splits(splits: DataFrame, out: str) -> None:
    """Write one folder per split; raises if a template of the unseen test set occurs in another part."""
    unseen = F.col("split") == "test_b"
    assert_no_leak(splits.filter(~unseen), splits.filter(unseen), "template_skeleton")
    splits.write.mode("overwrite").partitionBy("split").parquet(out)


def external_holdout(external: DataFrame, master: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """External test rows: trimmed, distinct, not in the master, binary label; channel SMS unless given."""
    rows = external.filter(F.col("cleaned_text").isNotNull())
    rows = filter_computed(
        rows.withColumn("cleaned_text", strip(F.col("cleaned_text"))), F.length("cleaned_text") >= 3
    )
    rows = keep_first(stored(rows, "external"), "cleaned_text", ordinal)
    if master is not None:
        rows = exclude_known(rows, master.select(strip(F.col("cleaned_text")).alias("cleaned_text")), "cleaned_text")
    rows = map_external_label(rows).withColumn("label_name", label_name(F.col("label")))
    return rows if "channel" in rows.columns else rows.withColumn("channel", F.lit("SMS"))
