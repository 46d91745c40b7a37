"""Readers with declared schemas: nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import strip
from ..functions.fixed import IMAGE_EXTENSIONS
from ..operators.filters import filter_computed
from ..operators.ordering import formatted_id, sequential_id
from ..operators.splits import first_per_class
from ..session import stored
from .records import csv_table, json_array

MESSAGES = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
BENCHMARK = T.StructType(
    [
        T.StructField("Evaluation Level", T.StringType()),
        T.StructField("Samples", T.LongType()),
        T.StructField("Accuracy (%)", T.DoubleType()),
        T.StructField("Macro F1 (%)", T.DoubleType()),
        T.StructField("Precision (%)", T.DoubleType()),
        T.StructField("Recall (%)", T.DoubleType()),
        T.StructField("Target", T.StringType()),
        T.StructField("Status", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("TP", "FP", "TN", "FN")],
    ]
)
QR_TEXT = ["qr_id", "image_filename", "image_path", "source_folder", "decoded_content", "normalized_url",
           "content_type", "decode_status", "domain", "decode_error"]


def qr_schema(columns: list[str]) -> T.StructType:
    """Schema of a QR table: texts, and integers for label and features."""
    return T.StructType(
        [T.StructField(c, T.StringType() if c in QR_TEXT else T.IntegerType()) for c in columns]
    )


def _numbered(df: DataFrame, columns: list[str], output: str = "ordinal") -> DataFrame:
    """Columns of reader output with ``ordinal``: 0, 1, 2, ... by file path and position in the file.

    Spark packs blocks of files into tasks by size, so row numbers of tasks say nothing about the input order. A block's
    offset is the number of rows in the blocks before it; that table has one row per input block, like the list of blocks that the
    driver plans the scan with, and is broadcast.
    """
    names = [F.col(f"`{c}`") for c in columns]
    rows = df.select(*names, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    blocks = rows.groupBy("__file", "__block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    blocks = blocks.select("__file", "__block", shift.alias("__shift"))
    rows = rows.join(F.broadcast(blocks), ["__file", "__block"])
    return rows.select(*names, (F.col("__row") + F.col("__shift")).cast("long").alias(output))


def read_messages_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Messages ``{text, label}`` with an ordinal in input order. A file is one JSON array, or one object per line.

    Files of either form are split over tasks.
    """
    if not lines:
        return json_array(spark, path, MESSAGES.simpleString()).select("text", "label", "ordinal")
    df = spark.read.schema(MESSAGES).json(path)
    return _numbered(df, df.columns)


def _raw_csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """A CSV with a header and doubled quotes: all columns as text, a byte order mark in the header removed."""
    df = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    marked = [c for c in df.columns if c.startswith("\ufeff")]
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in marked})


def _csv_rows(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """A CSV as text columns with ``__ordinal``. Fields may hold line breaks if ``multiline``; files are split either way."""
    raw = _raw_csv(spark, path, multiline)
    if not multiline:
        return _numbered(raw, raw.columns, "__ordinal")
    folders = [c for c in spark.read.text(path).columns if c != "value"]
    return csv_table(spark, path, [c for c in raw.columns if c not in folders])


def _columns(df: DataFrame, schema: T.StructType) -> list[Column]:
    """The columns of a schema, found by name and cast; missing text is the empty string, as in the files."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing in the header: {', '.join(missing)}")
    empty = F.lit("")
    out = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        out.append((F.coalesce(value, empty) if text else F.nullif(value, empty).cast(f.dataType)).alias(f.name))
    return out


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """CSV with a header, doubled quotes and a possible byte order mark; quoted fields may span lines.

    Columns are found by name, in any order; a column that is not there is an error. ``multiline=False`` reads files
    without such fields in one pass. Missing text is the empty string.
    """
    df = _csv_rows(spark, path, True) if multiline else _raw_csv(spark, path, False)
    return df.select(*_columns(df, schema))


def resolve_column(columns: list[str], name: str, fallback: int) -> str:
    """A column by name, a byte order mark aside; else by position, which may count from the end."""
    for column in columns:
        if column.lstrip("﻿") == name:
            return column
    return columns[fallback]


def read_url_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Columns URL and label of a wider CSV, else the first and the second last one; trimmed; label 0 or 1 only.

    ``multiline=False`` reads files whose fields hold no line breaks in fewer steps.
    """
    raw = _csv_rows(spark, path, multiline)
    named = [c for c in raw.columns if c != "__ordinal"]
    url, label = resolve_column(named, "URL", 0), resolve_column(named, "label", -2)
    pick = lambda c: strip(F.coalesce(F.col("`" + c + "`"), F.lit("")))
    # Bytes that are no UTF-8 arrive as replacement characters; they are dropped.
    rows = raw.select(F.replace(pick(url), F.lit("\ufffd"), F.lit("")).alias("raw_url"), pick(label).alias("label"), F.col("__ordinal").alias("ordinal"))
    rows = rows.filter(F.col("label").isin("0", "1")).withColumn("label", F.col("label").cast("int"))
    return rows.withColumn("source", F.lit("existing_url")).select("raw_url", "label", "source", "ordinal")


def qr_payload_url(df: DataFrame) -> Column:
    """``decoded_content``, else ``normalized_url``; the first that is not empty."""
    empty = F.lit("")
    names = [c for c in ("decoded_content", "normalized_url") if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c), empty) for c in names])


def qr_payloads(df: DataFrame, label: int, source: str = "qr_decoded") -> DataFrame:
    """URL rows of a QR table with an ordinal; rows without content are dropped, the rest is trimmed."""
    rows = filter_computed(df.withColumn("raw_url", qr_payload_url(df)), F.col("raw_url").isNotNull())
    return rows.select(
        strip(F.col("raw_url")).alias("raw_url"), F.lit(label).alias("label"), F.lit(source).alias("source"), "ordinal"
    )


def read_qr_payloads(spark: SparkSession, path: str, label: int, source: str = "qr_decoded", multiline: bool = True) -> DataFrame:
    """URL rows of a QR table in CSV, all with one label."""
    raw = _csv_rows(spark, path, multiline)
    fields = _columns(raw, qr_schema(["decoded_content", "normalized_url"]))
    return qr_payloads(raw.select(*fields, F.col("__ordinal").alias("ordinal")), label, source)


def capped_scan(df: DataFrame, n_per_class: int) -> DataFrame:
    """The first ``n_per_class`` rows of each label and source, in input order."""
    return first_per_class(df, ["source", "label"], n_per_class)


def read_capped(
    spark: SparkSession, path: str, read: Callable[[SparkSession, list[str]], DataFrame], n_per_class: int,
    classes: Sequence[int] = (0, 1), group_bytes: int = 1 << 30,
) -> tuple[DataFrame, list[str]]:
    """(rows, files read): the first ``n_per_class`` rows of each label in file order, without reading all files.

    ``read`` gives the rows of a list of files, with label and ordinal. Files are read in groups of about
    ``group_bytes``, each twice as large as the one before, until every label has its rows; a group is read once and
    its rows stored. Ordinals ascend over the groups. The driver holds the list of files, as it does for any scan.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    left = dict.fromkeys(classes, n_per_class)
    taken, used, first, at = None, [], 0, 0
    while at < len(listing) and any(left.values()):
        group, size = [], 0
        while at < len(listing) and (not group or size + listing[at]["length"] <= group_bytes):
            group.append(listing[at]["path"])
            size += listing[at]["length"]
            at += 1
        group_bytes *= 2
        used += group
        rows = stored(read(spark, group), "capped")
        total = rows.agg(F.max("ordinal")).first()[0]
        for label, n in left.items():
            if n:
                part = first_per_class(rows.filter(F.col("label") == label), ["label"], n)
                part = stored(part.withColumn("ordinal", F.col("ordinal") + first), "capped-rows")
                left[label] = n - part.count()
                taken = part if taken is None else taken.unionByName(part)
        first += 0 if total is None else total + 1
    if taken is None:
        raise ValueError(f"no files in {path}, or no class")
    return taken, used


def _images(spark: SparkSession, folder: str, label: int, name: str) -> DataFrame:
    # Only the path is selected, so file contents are never read.
    files = spark.read.format("binaryFile").load(folder).select("path")
    names = files.withColumn("image_filename", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))))
    wanted = F.lower("image_filename").rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")\z")
    return names.filter(wanted).select(
        "image_filename",
        F.regexp_replace("path", F.lit("^file:/*"), F.lit("/")).alias("image_path"),
        F.lit(name).alias("source_folder"),
        F.lit(label).alias("label"),
    )


def image_manifest(
    spark: SparkSession, folders: dict[str, tuple[str, int]], limit: int | None = None, prefix: str = "QR"
) -> DataFrame:
    """Image files of the folders (name -> (path, label)), numbered across folders by folder, then file name.

    ``limit`` keeps the first ``limit // 2`` files of each folder.
    """
    manifest = None
    for position, (name, (path, label)) in enumerate(folders.items()):
        part = _images(spark, path, label, name).withColumn("__folder", F.lit(position))
        manifest = part if manifest is None else manifest.unionByName(part)
    # A sort by range keeps every task's share bounded; the numbers that follow it are increasing in that order.
    # A fixed number of ranges: partition numbers must not depend on how a plan merges small partitions.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__folder", "image_filename"]
    ordered = manifest.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("__ordinal", F.monotonically_increasing_id())
    if limit:
        ordered = first_per_class(ordered, ["source_folder"], limit // 2, "__ordinal")
    numbered = sequential_id(ordered, "__ordinal", "__number", start=1)
    return numbered.select(
        formatted_id(prefix, F.col("__number")).alias("qr_id"), "image_filename", "image_path", "source_folder", "label"
    )


def pending_files(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose name is not among the decoded ones."""
    names = done.filter(F.coalesce("image_filename", F.lit("")) != "").select("image_filename").distinct()
    return manifest.join(names, "image_filename", "left_anti")


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, BENCHMARK)


def base64_payload(col: Column) -> Column:
    """Bytes of a base64 text; a data-URI head before the first comma is dropped."""
    comma = F.instr(col, ",")
    return F.unbase64(F.when(comma > 0, F.substr(col, comma + 1)).otherwise(col))
