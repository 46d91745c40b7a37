"""QR payload job: decoded texts to URL table, failures, duplicate report and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import QR_RAW_COLUMNS
from ..functions.qr import with_extracted_features
from ..operators.quality import decode_statistics, duplicate_report, duplicates_of, merge_partials, statistics_of
from ..operators.reports import DECODE_REPORT, report_lines, with_files
from ..session import stored
from ..sources.writers import successful_urls, write_csv, write_decodes, write_report


def qr_raw_table(decodes: DataFrame) -> DataFrame:
    """The 26-column decode table from (qr_id, image_filename, image_path, source_folder, label, payload).

    A null payload is a failed decode. ``ordinal`` and ``decode_error`` are used if present.
    """
    failed = F.col("payload").isNull()
    error = F.col("decode_error") if "decode_error" in decodes.columns else F.lit(None).cast("string")
    rows = with_extracted_features(decodes.withColumn("__error", error))
    rows = rows.withColumns(
        {
            "normalized_url": F.coalesce("normalized_url", F.lit("")),
            "decoded_content": F.when(failed, "").otherwise(F.col("content")),
            "decode_status": F.when(failed, "failed").otherwise("success"),
            "decode_error": F.when(failed, F.coalesce("__error", F.lit("decode_failed"))).otherwise(""),
        }
    )
    extra = [c for c in ("ordinal",) if c in decodes.columns]
    return rows.select(*QR_RAW_COLUMNS, *extra)


def rederive_status(urls: DataFrame) -> DataFrame:
    """Status, content type and error of a stored URL table, from what it holds."""
    has_url = F.coalesce("normalized_url", F.lit("")) != ""
    has_text = F.coalesce("decoded_content", F.lit("")) != ""
    return urls.withColumns(
        {
            "decode_status": F.when(has_url | has_text, "success").otherwise("failed"),
            "content_type": F.when(has_url, "url").when(has_text, "non_url").otherwise("unknown"),
            "decode_error": F.when(has_url | has_text, "").otherwise("decode_failed"),
            "url_length": F.length(F.coalesce("normalized_url", F.lit(""))),
        }
    )


def with_ordinal(raw: DataFrame) -> DataFrame:
    """Ids are numbered in input order, so they also give the order in which files were seen."""
    return raw.withColumn("ordinal", F.regexp_extract("qr_id", r"(\d+)$", 1).cast("long"))


def write_reports(duplicates: DataFrame, statistics: DataFrame, out: str) -> None:
    """The duplicate report, most frequent first, and the text report."""
    write_csv(duplicates.orderBy(F.desc("occurrence_count"), "normalized_url"), f"{out}/duplicates")
    layout = with_files(DECODE_REPORT, [f"{out}/{name}" for name in ("raw", "urls", "failed", "duplicates", "report")])
    write_report(report_lines(statistics, layout), f"{out}/report")


def rebuild_reports(raw: DataFrame, out: str) -> None:
    """Write the duplicate report and the text report of a stored decode table."""
    write_reports(duplicate_report(with_ordinal(successful_urls(raw))), decode_statistics(raw), out)


def merge_reports(partials: DataFrame, out: str) -> None:
    """Write both reports from the stored partials of all batches."""
    merged = stored(merge_partials(partials), "merged-partials")
    write_reports(duplicates_of(merged), statistics_of(merged), out)


def qr_payload_tables(spark: SparkSession, decodes: DataFrame, out: str) -> None:
    """Write the three decode tables, the duplicate report and the text report."""
    write_decodes(qr_raw_table(decodes), out)
    rebuild_reports(spark.read.parquet(f"{out}/raw"), out)
