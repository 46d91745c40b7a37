"""Writers. A write is parallel, one file per task; every write can be repeated after a failure."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import QR_FAILED_COLUMNS, QR_RAW_COLUMNS, QR_URL_COLUMNS

BUNDLE_VERSIONS = "version string, metrics boolean"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_by_channel(clean: DataFrame, path: str) -> None:
    """The master table and, below it, one folder per channel: written once, read as a whole or by channel."""
    clean.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("channel").csv(path)


def _success() -> Column:
    return F.col("decode_status") == "success"


def successful_urls(stored: DataFrame) -> DataFrame:
    """URL rows of a stored decode table; the filter reaches the files."""
    return stored.filter(_success() & (F.col("content_type") == "url"))


def route_decodes(stored: DataFrame) -> dict[str, DataFrame]:
    """The three views of a stored decode table: all rows (26 columns), URL rows (21), failures (6)."""
    return {
        "raw": stored.select(QR_RAW_COLUMNS),
        "urls": successful_urls(stored).select(QR_URL_COLUMNS),
        "failed": stored.filter(~_success()).select(QR_FAILED_COLUMNS),
    }


def write_decodes(raw: DataFrame, path: str, folder: str = "") -> None:
    """Write the full table once, then derive the two narrower ones from what was written.

    Reading back costs less than running the payload regexes three times, and needs no executor memory that a lost
    executor would take along. ``folder`` is a subfolder of each table, for the batches of a stream.
    """
    raw.select(QR_RAW_COLUMNS).write.mode("overwrite").parquet(f"{path}/raw{folder}")
    stored = raw.sparkSession.read.schema(raw.select(QR_RAW_COLUMNS).schema).parquet(f"{path}/raw{folder}")
    for name, part in route_decodes(stored).items():
        if name != "raw":
            part.write.mode("overwrite").parquet(f"{path}/{name}{folder}")


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a table; pass only rows that are not there yet (``pending_files``)."""
    df.write.mode("append").parquet(path)


def export_formats(splits: dict[str, DataFrame], path: str) -> None:
    """Every split as CSV and as Parquet."""
    for name, df in splits.items():
        write_csv(df, f"{path}/{name}_csv")
        df.write.mode("overwrite").parquet(f"{path}/{name}_parquet")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (line_no, line) as one text file; a report has a fixed number of lines."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_files(files: DataFrame, root: str) -> None:
    """A file below ``root`` for every row (relative path, content as binary). Tasks write their own rows' files.

    ``root`` is a URI of a file system that pyarrow knows, or a local path.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(os.path.dirname(f"{base}/{name}"), recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content or b"")
            yield batch

    files.mapInArrow(write, files.schema).write.format("noop").mode("overwrite").save()


def save_bundle(model: PipelineModel, path: str, metrics: DataFrame | None = None) -> str:
    """A new version of the bundle below ``path``: the model, its validation metrics and their columns.

    The version becomes the current one by its last step, one row that names it; a job that ends before leaves the
    current version as it was, and readers of older versions keep them. Returns the version.
    """
    spark = SparkSession.getActiveSession()
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{path}/{version}/model")
    if metrics is not None:
        metrics.write.parquet(f"{path}/{version}/metrics")
        columns = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(metrics.schema.fields)]
        spark.createDataFrame(columns, "place int, name string, type string").coalesce(1).write.parquet(f"{path}/{version}/columns")
    named = spark.createDataFrame([(version, metrics is not None)], BUNDLE_VERSIONS)
    named.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def bundle_version(path: str) -> tuple[str, bool]:
    """The current version of a bundle, and whether it has metrics."""
    versions = SparkSession.getActiveSession().read.schema(BUNDLE_VERSIONS).parquet(f"{path}/versions")
    last = versions.orderBy(F.desc("version")).first()
    if last is None:
        raise ValueError(f"no bundle in {path}")
    return last["version"], last["metrics"]


def load_bundle(path: str) -> PipelineModel:
    """The model of the current version."""
    return PipelineModel.load(f"{path}/{bundle_version(path)[0]}/model")


def load_bundle_metrics(path: str) -> DataFrame:
    """The validation metrics stored with the current version, in the order and types of its column table."""
    version, has_metrics = bundle_version(path)
    if not has_metrics:
        raise ValueError(f"the bundle in {path} has no metrics")
    spark = SparkSession.getActiveSession()
    columns = spark.read.parquet(f"{path}/{version}/columns").orderBy("place").collect()
    schema = ", ".join(f"`{r['name']}` {r['type']}" for r in columns)
    return spark.read.schema(schema).parquet(f"{path}/{version}/metrics")


def has_bundle(path: str) -> bool:
    """Whether a version was completed below ``path``."""
    spark = SparkSession.getActiveSession()
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
