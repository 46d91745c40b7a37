"""Incremental ingest of decode tables: only files not seen before are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import QR_FAILED_COLUMNS, QR_RAW_COLUMNS, QR_URL_COLUMNS
from ..operators.quality import decode_partials
from ..plans.qr import merge_reports, qr_raw_table, with_ordinal
from ..sources.writers import write_decodes

TABLES = {"raw": QR_RAW_COLUMNS, "urls": QR_URL_COLUMNS, "failed": QR_FAILED_COLUMNS}


def ingest_decodes(decodes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run all pending input through the QR tables and stop.

    The checkpoint remembers which files are done. Each batch writes to its own folder and replaces it, so a batch
    that is repeated after a failure leaves the same rows.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        folder = f"/batch={batch_id}"
        write_decodes(qr_raw_table(batch), out, folder)
        raw = batch.sparkSession.read.parquet(f"{out}/raw{folder}")
        decode_partials(with_ordinal(raw), "ordinal").write.mode("overwrite").parquet(f"{out}/partials{folder}")

    return (
        decodes.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, out: str, table: str = "raw") -> DataFrame:
    return spark.read.parquet(f"{out}/{table}").select(TABLES[table])


def resume_decodes(decodes: DataFrame, out: str, checkpoint: str) -> None:
    """Ingest what is pending, then write the duplicate report, the statistics and the text report of all batches.

    The reports come from the batches' partials, one row for each URL of a batch; rows of earlier batches are not read again.
    """
    ingest_decodes(decodes, out, checkpoint).awaitTermination()
    merge_reports(decodes.sparkSession.read.parquet(f"{out}/partials"), out)
