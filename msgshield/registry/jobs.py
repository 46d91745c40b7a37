"""Queries that write and read back, run streams or fit models; registered next to the table queries."""

from __future__ import annotations

import hashlib
import os

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import strip
from ..functions.fixed import CLEAN_COLUMNS, MESSAGE_FEATURES, URL_FEATURES
from ..functions.qr import strip_series_artifact
from ..functions.signals import with_message_signals
from ..functions.urls import looks_like_url, with_canonical_url, with_url_features
from ..operators import boosting, joins, metrics, terms
from ..operators.quality import decode_statistics
from ..operators.reports import DECODE_REPORT, MESSAGE_BENCHMARK, URL_BENCHMARK, benchmark_report, markdown_rows
from ..operators.reports import report_lines, with_files
from ..plans import evaluation, scoring, training
from ..plans import messages as message_jobs
from ..plans import qr as qr_jobs
from ..plans import urls as url_jobs
from ..session import shared_dir, stored
from ..sources import readers, writers
from ..streaming.ingest import ingest_decodes, read_ingested, resume_decodes
from ..streaming.scoring import stream_score, write_scores
from . import inputs, sql
from .catalog import _CANON, _CORPUS, _DECODE_CTE, _ECE, _MATRIX_CTES, _MATRIX_SELECT, _MSG_PROB, _QR, _RATE_COLUMNS, _SCORED_QR
from .catalog import _SCORED_URLS, _SCORE_QR_SELECT, _SUITE_CTES, _SUITE_SELECT
from .catalog import _flat_indicators, _score_messages_select, _score_urls_select, _scored_messages, _stored_corpus
from .catalog import ORACLES, ROUTED_SQL, _row_digest, _stored_text, register, routed_digests, row_digest_sql
from .sql import CLEAN_CHAIN, URL_SPLIT_CHAIN, big

# --- sources and sinks ---------------------------------------------------------------------------


@register(
    "messages_json",
    CLEAN_CHAIN[:1],
    "SELECT md5(text) AS digest, CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n FROM raw_messages GROUP BY ALL",
)
def messages_json(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written as JSON and read with the declared schema."""
    path = shared_dir(spark, "messages-json")
    inputs.raw_messages(spark, sf).select("text", "label").write.option("ignoreNullFields", False).json(path)
    rows = readers.read_messages_json(spark, path, lines=True)
    return rows.groupBy(F.md5("text").alias("digest"), "label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "messages_array",
    CLEAN_CHAIN[:1],
    "SELECT md5(text) AS digest, CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n FROM raw_messages GROUP BY ALL",
)
def messages_array(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as files of one JSON array each, 4,096 messages at most, read by byte ranges."""
    path = shared_dir(spark, "messages-array")
    rows = inputs.raw_messages(spark, sf).select(F.shiftright("ordinal", 12).alias("file"), F.to_json(F.struct("text", "label")).alias("row"))
    arrays = rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = readers.read_messages_json(spark, path)
    return read.groupBy(F.md5("text").alias("digest"), "label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "csv_table",
    ["decodes", "extracted", "qr_urls", "qr_raw"],
    "SELECT qr_id, decoded_content, normalized_url, CAST(url_length AS BIGINT) AS url_length FROM qr_raw",
)
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    """The decode table as CSV, with line breaks and quotes in fields, and back."""
    path = shared_dir(spark, "decodes-csv")
    raw = qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)).drop("ordinal")
    writers.write_csv(raw, path)
    rows = readers.read_csv_table(spark, path, readers.qr_schema(raw.columns))
    return rows.select("qr_id", "decoded_content", "normalized_url", "url_length")


@register(
    "url_csv",
    ["sources"],
    "SELECT trim(raw_url) AS raw_url, CAST(label AS BIGINT) AS label, 'existing_url' AS source FROM sources",
)
def url_csv(spark: SparkSession, sf: str) -> DataFrame:
    """S3: a wide CSV in which the URL and label columns are found by name."""
    path = shared_dir(spark, "urls-csv")
    rows = inputs.url_sources(spark, sf).select("source", F.col("raw_url").alias("URL"), F.col("label").cast("string"), "ordinal")
    writers.write_csv(rows, path)
    return readers.read_url_csv(spark, path).select("raw_url", "label", "source")


@register(
    "channel_sink",
    CLEAN_CHAIN,
    "SELECT channel, 'MSG_' || lpad(CAST(number AS VARCHAR), 6, '0') AS message_id, md5(cleaned_text) AS text_digest FROM clean",
)
def channel_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The clean corpus written by channel and read back."""
    path = shared_dir(spark, "by-channel")
    clean = message_jobs.clean_messages(inputs.raw_messages(spark, sf)).select(CLEAN_COLUMNS)
    writers.write_by_channel(clean, path)
    rows = readers.read_csv_table(spark, path, clean.schema)
    return rows.select("channel", "message_id", F.md5("cleaned_text").alias("text_digest"))


@register(
    "export_formats",
    [*_CORPUS, *URL_SPLIT_CHAIN],
    f"SELECT split, format, {row_digest_sql(url_jobs.CORPUS_COLUMNS)} FROM url_splits, (VALUES ('csv'), ('parquet')) AS f(format)",
)
def export_formats(spark: SparkSession, sf: str) -> DataFrame:
    """K5: every split as CSV and Parquet."""
    path = shared_dir(spark, "export")
    splits = stored(url_jobs.url_splits(_stored_corpus(spark, sf)), "splits")
    names = url_jobs.SPLIT_FILES
    writers.export_formats({n: splits.filter(F.col("split") == n) for n in names}, path)
    out = None
    for name in names:
        for kind in ("csv", "parquet"):
            reader = spark.read.schema(splits.schema)
            rows = reader.option("header", True).csv(f"{path}/{name}_csv") if kind == "csv" else reader.parquet(f"{path}/{name}_parquet")
            row = rows.select("split", F.lit(kind).alias("format"), _row_digest(url_jobs.CORPUS_COLUMNS))
            out = row if out is None else out.unionByName(row)
    return out


_DUPLICATES = ["normalized_url", "occurrence_count", "benign_count", "malicious_count", "is_cross_label_conflict", "sample_image_filenames"]


@register(
    "decode_tables",
    [*_QR, "qr_raw", ("d", ORACLES["duplicate_report"].rsplit("\n", 1)[1])],
    f"{ROUTED_SQL} UNION ALL SELECT 'duplicates', {row_digest_sql(_DUPLICATES)} FROM d",
)
def decode_tables(spark: SparkSession, sf: str) -> DataFrame:
    """C4, K3: the whole QR job; every row of its output files."""
    path = shared_dir(spark, "qr-job")
    qr_jobs.qr_payload_tables(spark, inputs.qr_decodes(spark, sf), path)
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in ("raw", "urls", "failed")}
    parts["duplicates"] = spark.read.option("header", True).option("escape", '"').csv(f"{path}/duplicates")
    return routed_digests(parts)


def _report_sql(layout: list = DECODE_REPORT) -> str:
    """The report lines as one SQL list over the statistics ``d``."""

    def line(template: str, columns: list[str]) -> str:
        if not columns:
            return sql.lit(template)
        head = template.split("%", 1)[0]
        if "%," in template:
            return f"{sql.lit(head)} || format('{{:,}}', {columns[0]})"
        return f"{sql.lit(head)} || printf('%.2f', {columns[0]}) || '%'"

    return "[" + ", ".join(line(*entry) for entry in layout) + "]"


@register(
    "decode_report",
    [*_QR, "qr_raw", _DECODE_CTE, ("d", f"SELECT *, {_RATE_COLUMNS} FROM s"),
     ("l", f"SELECT {_report_sql()} AS lines FROM d")],
    "SELECT CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT lines, unnest(generate_series(1, len(lines))) AS i FROM l)",
)
def decode_report(spark: SparkSession, sf: str) -> DataFrame:
    """K6: report lines of the decode statistics."""
    return report_lines(decode_statistics(qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf))), DECODE_REPORT)


_REPORT_LINE = (
    "'| **' || level || '** | ' || samples || ' | **' || printf('%.2f', accuracy) || '%** | ' || printf('%.2f', macro_f1) || '% | ' "
    "|| printf('%.2f', macro_precision) || '% | ' || printf('%.2f', macro_recall) || '% | ' || target || ' | ' || status || ' |'"
)


@register(
    "metrics_report",
    [*_MATRIX_CTES, ("m", _MATRIX_SELECT)],
    f"SELECT CAST(1 + row_number() OVER (ORDER BY level) AS BIGINT) AS line_no, {_REPORT_LINE} AS line FROM m "
    f"UNION ALL SELECT 0, {sql.lit('| ' + ' | '.join(evaluation.MESSAGE_REPORT) + ' |')} "
    f"UNION ALL SELECT 1, '| :--- |' || repeat(' :---: |', {len(evaluation.MESSAGE_REPORT) - 1})",
)
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """K6: the message matrix as Markdown lines."""
    return markdown_rows(metrics.message_matrix(inputs.scored_rows(spark, sf)), evaluation.MESSAGE_REPORT, ["level"])


def _benchmark_lines_sql(layout: dict, cells: str, rule: str) -> str:
    """The lines of a whole report as one SQL list over the matrix ``m``. ``cells``: one SQL line for each table."""
    parts = [f"[{sql.lit(layout['title'])}, '']"]
    for (heading, fields), line in zip(layout["tables"], cells, strict=True):
        head = "| " + " | ".join(name for name, _, _ in fields) + " |"
        parts.append(f"[{sql.lit(heading)}, '', {sql.lit(head)}, '| :--- |' || repeat(' :---: |', {len(fields) - 1})]")
        parts += [f"(SELECT list({line} ORDER BY {rule}) FROM m)", "['']"]
    parts.append("[" + ", ".join(sql.lit(x) for x in layout["closing"]) + "]")
    return " || ".join(parts)


_COUNT_CELLS = "'| ' || {name} || ' | ' || TP || ' | ' || FP || ' | ' || TN || ' | ' || FN || ' |'"


@register(
    "message_report",
    [*_MATRIX_CTES, ("m", _MATRIX_SELECT),
     ("l", f"SELECT {_benchmark_lines_sql(MESSAGE_BENCHMARK, [_REPORT_LINE, _COUNT_CELLS.format(name='level')], 'level')} AS lines")],
    "SELECT CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT lines, unnest(generate_series(1, len(lines))) AS i FROM l)",
)
def message_report(spark: SparkSession, sf: str) -> DataFrame:
    """K6: the whole evaluation report of the messages, with the confusion counts and the closing section."""
    return benchmark_report(metrics.message_matrix(inputs.scored_rows(spark, sf)), MESSAGE_BENCHMARK, ["level"])


@register(
    "url_report",
    [*_SUITE_CTES, ("m", _SUITE_SELECT),
     ("l", "SELECT " + _benchmark_lines_sql(URL_BENCHMARK, [
         "'| **' || title || '** | ' || samples || ' | **' || printf('%.2f', accuracy) || '%** | ' || printf('%.2f', precision) || '% | ' "
         "|| printf('%.2f', recall) || '% | **' || printf('%.2f', f1) || '%** | ' || printf('%.4f', roc_auc) || ' | ' || printf('%.2f', ece) "
         "|| '% | ' || status || ' |'", _COUNT_CELLS.format(name="title")], "title") + " AS lines")],
    "SELECT CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT lines, unnest(generate_series(1, len(lines))) AS i FROM l)",
)
def url_report(spark: SparkSession, sf: str) -> DataFrame:
    """K6: the whole evaluation report of the URL suites."""
    return benchmark_report(metrics.url_suite_matrix(inputs.scored_rows(spark, sf)), URL_BENCHMARK, ["title"])


_IMAGE = "printf('%08d', s_suppkey) || CASE s_suppkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' ELSE '.png' END"


@register(
    "image_listing",
    [("files", f"SELECT {_IMAGE} AS image_filename, CAST(s_suppkey % 2 AS BIGINT) AS label FROM supplier WHERE s_suppkey % 5 <> 0")],
    "SELECT 'QR_' || printf('%06d', row_number() OVER (ORDER BY label, image_filename)) AS qr_id, image_filename, "
    "CASE label WHEN 1 THEN 'malicious' ELSE 'benign' END AS source_folder, label FROM files",
)
def image_listing(spark: SparkSession, sf: str) -> DataFrame:
    """One file for each supplier written into two folders; the images among them, sorted and numbered."""
    root = shared_dir(spark, "images")
    key = F.col("s_suppkey")
    ending = F.when(key % 5 == 0, ".txt").when(key % 5 == 1, ".PNG").when(key % 5 == 2, ".jpg").otherwise(".png")
    folder = F.when(key % 2 == 1, "malicious").otherwise("benign")
    names = inputs.table(spark, sf, "supplier").select(F.concat(folder, F.lit("/"), F.lpad(key.cast("string"), 8, "0"), ending).alias("name"))
    writers.write_files(names.select("name", F.encode("name", "UTF-8").alias("content")), root)
    found = readers.image_manifest(spark, {"benign": (f"{root}/benign", 0), "malicious": (f"{root}/malicious", 1)})
    return found.select("qr_id", "image_filename", "source_folder", "label")


@register(
    "base64_payload",
    [],
    "SELECT page_id, url AS decoded FROM pages",
)
def base64_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as data URIs, decoded again."""
    encoded = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("url", "UTF-8")))
    pages = inputs.table(spark, sf, "pages").select("page_id", encoded.alias("uri"))
    return pages.select("page_id", F.decode(readers.base64_payload(F.col("uri")), "UTF-8").alias("decoded"))


@register(
    "payload_kinds",
    ["decodes", "extracted"],
    "SELECT ordinal, content, CAST(starts_with(lower(c), 'http://') OR starts_with(lower(c), 'https://') OR starts_with(lower(c), 'ftp://') "
    "OR starts_with(lower(c), 'www.') OR (contains(c, '.') AND contains(c, '/')) AS BIGINT) AS is_url "
    "FROM (SELECT ordinal, content, coalesce(payload, '') AS c FROM extracted)",
)
def payload_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads without the printed-column artifact, and whether they look like a URL."""
    rows = inputs.qr_decodes(spark, sf)
    return rows.select(
        "ordinal",
        strip_series_artifact(F.col("payload")).alias("content"),
        looks_like_url(F.coalesce("payload", F.lit(""))).alias("is_url"),
    )


# --- streams -------------------------------------------------------------------------------------


def _as_stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stored table read as a stream of files."""
    path = shared_dir(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _run(spark: SparkSession, scored: DataFrame, name: str) -> DataFrame:
    out = shared_dir(spark, f"{name}-out")
    write_scores(scored, out, shared_dir(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


@register("stream_urls", _SCORED_URLS, f"SELECT ordinal, {_score_urls_select('direct_url')} FROM t")
def stream_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URL scoring as a stream; the same result as the batch."""
    rows = _as_stream(spark, inputs.url_variants(spark, sf), "url-stream")
    out = _run(spark, stream_score(rows, "urls", "raw_url"), "url-scores")
    return _flat_indicators(out.drop("raw_url", "label"))


@register("stream_messages", _scored_messages(_MSG_PROB), f"SELECT {_score_messages_select()} FROM t")
def stream_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message scoring as a stream."""
    rows = _as_stream(spark, _stored_text(spark, sf), "message-stream")
    return _run(spark, stream_score(rows, "messages", "cleaned_text"), "message-scores").drop("label", "cleaned_text")


@register("stream_qr", _SCORED_QR, _SCORE_QR_SELECT)
def stream_qr(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring of QR payloads as a stream."""
    rows = _as_stream(spark, inputs.qr_decodes(spark, sf), "qr-stream")
    out = _run(spark, stream_score(rows, "qr", "payload"), "qr-scores")
    return out.select("ordinal", "risk_score", "severity", "action", "success", "error", "normalized_url")


@register(
    "stream_ingest",
    [*_QR, "qr_raw"],
    "SELECT qr_id, normalized_url, content_type, decode_status, " + big("url_length") + " AS url_length FROM qr_raw",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental ingest of decode results."""
    rows = _as_stream(spark, inputs.qr_decodes(spark, sf), "decode-stream")
    out = shared_dir(spark, "ingest-out")
    ingest_decodes(rows, out, shared_dir(spark, "ingest-checkpoint")).awaitTermination()
    return read_ingested(spark, out).select("qr_id", "normalized_url", "content_type", "decode_status", "url_length")


@register(
    "resume_reports",
    [*_QR, "qr_raw", _DECODE_CTE, ("d", f"SELECT *, {_RATE_COLUMNS} FROM s"),
     ("l", f"SELECT {_report_sql(with_files(DECODE_REPORT, [f'<out>/{n}' for n in ('raw', 'urls', 'failed', 'duplicates', 'report')]))} AS lines FROM d")],
    "SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(lines) AS line FROM l) GROUP BY line",
)
def resume_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries ingested one after the other; statistics and reports rebuilt from all batches."""
    rows = stored(inputs.qr_decodes(spark, sf), "decodes")
    path, out, checkpoint = (shared_dir(spark, f"resume-{n}") for n in ("in", "out", "checkpoint"))
    # Each row arrives once, in the first or in the second delivery.
    for late in (False, True):
        rows.filter((F.col("label") == 1) if late else (F.col("label") == 0)).write.mode("append").parquet(path)
        resume_decodes(spark.readStream.schema(rows.schema).parquet(path), out, checkpoint)
    lines = spark.read.text(f"{out}/report").select(F.replace("value", F.lit(out), F.lit("<out>")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@register(
    "capped_files",
    ["sources"],
    "SELECT raw_url, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ordinal) AS place "
    "FROM sources WHERE source = 'existing_url') WHERE place <= 50",
)
def capped_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows of each label from a table in many files, read until the labels are full; the cap is the operator."""
    path = shared_dir(spark, "capped-files")
    rows = inputs.url_sources(spark, sf).filter("source = 'existing_url'")
    rows = rows.select(F.lit("").alias("note"), "label", F.col("raw_url").alias("URL"), "ordinal").repartitionByRange(4, "ordinal")
    writers.write_csv(rows.sortWithinPartitions("ordinal"), path)
    found, _ = readers.read_capped(spark, path, lambda s, files: readers.read_url_csv(s, files, multiline=False), 50, group_bytes=4096)
    return found.select("raw_url", "label")


@register("holdout_stored")
def holdout_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Two external batches, one after the other, against the stored digests of the master's texts."""
    path = shared_dir(spark, "digests")
    name = "digests_" + os.path.basename(path).rsplit("-", 1)[1]
    master = inputs.master_messages(spark, sf).select(strip(F.col("cleaned_text")).alias("cleaned_text"))
    joins.store_digests(master, "cleaned_text", name, path)
    rows = stored(message_jobs.external_holdout(inputs.external_messages(spark, sf)), "external-rows")
    first, second = (joins.exclude_stored(rows.filter(F.col("ordinal") % 2 == k), name, "cleaned_text") for k in (0, 1))
    return first.unionByName(second).select("ordinal", "label", "label_name", "channel", F.md5("cleaned_text").alias("text_digest"))


ORACLES["holdout_stored"] = ORACLES["holdout_anti_join"]


@register(
    "append_resume",
    ["decodes"],
    "SELECT image_filename, CAST(1 AS BIGINT) AS n FROM decodes",
)
def append_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended in two parts, the second of what is pending; every file is there once."""
    path = shared_dir(spark, "appended")
    files = stored(inputs.qr_decodes(spark, sf).select("image_filename", "label"), "files")
    writers.append_rows(files.filter("label = 1"), path)
    done = spark.read.schema(files.schema).parquet(path)
    writers.append_rows(stored(readers.pending_files(files, done), "pending").select(files.columns), path)
    appended = spark.read.schema(files.schema).parquet(path)
    return appended.groupBy("image_filename").agg(F.count(F.lit(1)).alias("n"))


@register(
    "file_order",
    [],
    "SELECT CAST(row_number() OVER (ORDER BY file, doc_id) - 1 AS BIGINT) AS ordinal, md5(text) AS digest, CAST(doc_id % 2 AS BIGINT) AS label "
    "FROM (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS file FROM documents)",
)
def file_order(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as three files of unequal size; ordinals follow file name and position."""
    path = shared_dir(spark, "files")
    docs = inputs.table(spark, sf, "documents")
    file = F.when(F.col("doc_id") % 50 == 0, 0).when(F.col("doc_id") % 3 == 0, 1).otherwise(2)
    docs = stored(docs.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"), file.alias("file")), "docs")
    for k in range(3):
        part = docs.filter(F.col("file") == k).coalesce(1).sortWithinPartitions("doc_id").select("text", "label")
        part.write.option("ignoreNullFields", False).json(f"{path}/{k}")
    rows = readers.read_messages_json(spark, f"{path}/*", lines=True)
    return rows.select("ordinal", F.md5("text").alias("digest"), "label")


_BENCHMARK_COLUMNS = {
    "Evaluation Level": "level", "Samples": "samples", "Accuracy (%)": "accuracy", "Macro F1 (%)": "macro_f1",
    "Precision (%)": "macro_precision", "Recall (%)": "macro_recall", "Target": "target", "Status": "status",
    "TP": "TP", "FP": "FP", "TN": "TN", "FN": "FN",
}


@register("benchmark_csv", [*_MATRIX_CTES, ("m", _MATRIX_SELECT)], "SELECT " + ", ".join(_BENCHMARK_COLUMNS.values()) + " FROM m")
def benchmark_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The message matrix written as a benchmark file and read back."""
    path = shared_dir(spark, "benchmark")
    matrix = metrics.message_matrix(inputs.scored_rows(spark, sf))
    writers.write_csv(matrix.select([F.col(c).alias(name) for name, c in _BENCHMARK_COLUMNS.items()]), path)
    rows = readers.read_benchmark_csv(spark, path)
    return rows.select([F.col(f"`{name}`").alias(c) for name, c in _BENCHMARK_COLUMNS.items()])


_URL_JOB_COLUMNS = ", ".join(url_jobs.CORPUS_COLUMNS).replace("label", "CAST(label AS BIGINT) AS label")


@register(
    "url_job",
    [*_CORPUS, *URL_SPLIT_CHAIN, ("t", ORACLES["balanced_sample"].rsplit("\n", 1)[1])],
    f"SELECT split AS file, {_URL_JOB_COLUMNS} FROM url_splits "
    f"UNION ALL SELECT 'test_temporal', {_URL_JOB_COLUMNS} FROM url_splits WHERE normalized_url IN (SELECT normalized_url FROM t)",
)
def url_job(spark: SparkSession, sf: str) -> DataFrame:
    """CSV tables in, six CSV tables out; every row of each."""
    path = shared_dir(spark, "url-job")
    rows = stored(inputs.url_sources(spark, sf), "sources")

    def write(part: DataFrame, name: str) -> str:
        writers.write_csv(part.repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal").drop("ordinal"), f"{path}/{name}")
        return f"{path}/{name}"

    labelled = rows.filter("source = 'existing_url'")
    labelled = labelled.select(F.lit("x").alias("note"), F.col("label"), F.col("raw_url").alias("URL"), "ordinal")
    qr = rows.filter("source = 'qr_decoded'").select("label", F.lit("").alias("normalized_url"), F.col("raw_url").alias("decoded_content"), "ordinal")
    payloads = {write(qr.filter(F.col("label") == k), f"qr_{k}"): k for k in (0, 1)}
    url_jobs.build_url_splits(spark, write(labelled, "labelled"), payloads, f"{path}/out")
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "label" else T.StringType()) for c in url_jobs.CORPUS_COLUMNS])
    out = None
    for name in [*url_jobs.SPLIT_FILES, "test_temporal"]:
        part = readers.read_csv_table(spark, f"{path}/out/{name}", schema).withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- models --------------------------------------------------------------------------------------

def _url_split_table(spark: SparkSession, sf: str) -> DataFrame:
    return stored(url_jobs.url_splits(_stored_corpus(spark, sf)), "splits")


def _url_bundle(spark: SparkSession, sf: str) -> str:
    """The folder of the bundle of a data set: fitted by the first query of an application that needs it, then read."""
    path = f"{os.path.dirname(shared_dir(spark, 'x'))}/url-bundle-{hashlib.md5(sf.encode()).hexdigest()}"
    if not writers.has_bundle(path):
        splits = _url_split_table(spark, sf)
        train, validation = (splits.filter(F.col("split") == s) for s in ("train", "validation"))
        model, report = training.train_and_calibrate(train, validation)
        writers.save_bundle(model, path, report)
    return path


@register("url_model_metrics")
def url_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees with isotonic calibration; the validation metrics stored with the bundle."""
    return writers.load_bundle_metrics(_url_bundle(spark, sf))


@register("url_evaluation")
def url_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The model bundle loaded and evaluated on the four suites."""
    model = writers.load_bundle(_url_bundle(spark, sf))
    return evaluation.evaluate_urls(model, url_jobs.test_suites(_url_split_table(spark, sf)))


def _message_split_table(spark: SparkSession, sf: str) -> DataFrame:
    return stored(message_jobs.message_splits(_stored_text(spark, sf)), "message-splits")


@register("message_evaluation")
def message_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid model on test A and B, and on the external holdout as test C."""
    splits = _message_split_table(spark, sf)
    model = training.fit_message_model(splits.filter(F.col("split") == "train"))
    external = message_jobs.external_holdout(inputs.external_messages(spark, sf), splits)
    external = external.withColumn("split", F.lit("test_c")).select("cleaned_text", "channel", "label", "split")
    tests = splits.filter(F.col("split").startswith("test_")).select("cleaned_text", "channel", "label", "split")
    return evaluation.evaluate_messages(model, tests.unionByName(external))


@register("stage_comparison")
def stage_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Three model stages side by side."""
    splits = _message_split_table(spark, sf)
    stages = {"Stage 1": "baseline", "Stage 2": "semantic", "Stage 3": "hybrid"}
    train = training.count_messages(splits.filter(F.col("split") == "train"), stages.values())
    tests = splits.filter(F.col("split").isin("test_a", "test_b")).select("cleaned_text", "channel", "split", "label")
    tests = train.count(tests, stages.values(), "test-counts").drop("cleaned_text", "channel")
    out = None
    for stage, kind in stages.items():
        rows = training.predict_messages(training.fit_message_model(train, kind), tests)
        rows = rows.select(F.lit(stage).alias("stage"), "split", "label", "pred")
        out = rows if out is None else out.unionByName(rows)
    return metrics.stage_comparison(out)


# The isotonic fit at a score: the highest, over the scores at or below it, of the least mean label from there to a score
# at or above it.
_FITTED = [
    "scored",
    ("points", "SELECT prob, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS w FROM scored GROUP BY prob"),
    ("sums", "SELECT prob, row_number() OVER (ORDER BY prob) AS i, sum(y) OVER (ORDER BY prob) AS sy, sum(w) OVER (ORDER BY prob) AS sw, y, w FROM points"),
    ("spans", "SELECT a.i AS i, b.i AS j, (b.sy - a.sy + a.y) / (b.sw - a.sw + a.w) AS m FROM sums a JOIN sums b ON b.i >= a.i"),
    ("least_means", "SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM spans"),
    ("fit", "SELECT j, max(m) AS calibrated FROM least_means GROUP BY j"),
    ("calibrated", "SELECT scored.* EXCLUDE (prob), prob AS raw, least(1.0::DOUBLE, greatest(0.0::DOUBLE, calibrated)) AS cal "
     "FROM scored JOIN sums USING (prob) JOIN fit ON j = i"),
]


def _calibration_error_sql(column: str) -> str:
    return _ECE.format(g="split").replace("prob", column).replace("FROM scored", "FROM calibrated")


@register(
    "calibration",
    [*_FITTED, ("a", _calibration_error_sql("raw")), ("b", _calibration_error_sql("cal"))],
    "SELECT split, round(a.ece, 6) AS raw_ece, round(b.ece, 6) AS calibrated_ece, round(b.brier, 6) AS brier_score FROM a JOIN b USING (split)",
)
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Isotonic calibration of scored rows, with error before and after."""
    return _calibrated(spark, sf)[1]


def _calibrated(spark: SparkSession, sf: str) -> tuple:
    """(calibrator, errors before and after) of the scored rows."""
    rows = inputs.scored_rows(spark, sf)
    rows = rows.withColumn("probability", array_to_vector(F.array(1.0 - F.col("prob"), F.col("prob"))))
    model = training.fit_calibrator(rows)
    fitted = model.transform(rows)
    fitted = fitted.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))
    raw = metrics.calibration_error(fitted, "split").select("split", F.col("ece").alias("raw_ece"))
    cal = metrics.calibration_error(fitted, "split", prob="calibrated")
    cal = cal.select("split", F.col("ece").alias("calibrated_ece"), F.col("brier").alias("brier_score"))
    return model, raw.join(cal, "split")


@register("bundle_metrics")
def bundle_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """K7: two versions of a calibrator bundle; the metrics of the current one are those it was saved with."""
    path = shared_dir(spark, "calibrator")
    model, report = _calibrated(spark, sf)
    writers.save_bundle(PipelineModel(stages=[model]), path, report.limit(1))
    writers.save_bundle(PipelineModel(stages=[model]), path, report)
    return writers.load_bundle_metrics(path)


ORACLES["bundle_metrics"] = ORACLES["calibration"]


def _gain_ctes(table: str, names: list[str]) -> list:
    """The gain of every split at the root of the first tree over ``table`` (features and label). Margins are 0 there, as the
    classes weigh the same, so every hessian is a quarter of the weight."""
    values = "MAP {" + ", ".join(f"'{n}': round({n}, 6)::DOUBLE" for n in names) + "}"
    bins = boosting.BINS
    return [
        ("weights", f"SELECT label, sum(count(*)) OVER () / (2.0::DOUBLE * count(*)) AS w FROM {table} GROUP BY label"),
        ("cells", f"SELECT label, w, unnest(map_entries({values})) AS e FROM {table} JOIN weights USING (label)"),
        ("points", "SELECT e.key AS feature, e.value AS x, w * (0.5::DOUBLE - label) AS g, w * 0.25::DOUBLE AS h FROM cells"),
        ("placed", "SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) AS i, count(*) OVER (PARTITION BY feature) AS n FROM points"),
        ("cuts", f"SELECT DISTINCT feature, x AS cut FROM placed, generate_series(1, {bins - 1}) t(k) WHERE i = ceil(k * n / {bins}.0::DOUBLE)"),
        ("sides", "SELECT c.feature, cut, count(*) FILTER (x <= cut) AS n_left, count(*) AS n, sum(g) FILTER (x <= cut) AS gl, sum(h) FILTER (x <= cut) AS hl, "
         "sum(g) AS g, sum(h) AS h FROM cuts c JOIN points p ON p.feature = c.feature GROUP BY ALL"),
    ]


_GAIN_CTES = [*_CANON, "url_parts", "url_features", *_gain_ctes("url_features", URL_FEATURES)]


@register(
    "url_split_gains",
    _GAIN_CTES,
    f"SELECT feature, cut, n_left, round((gl * gl / (hl + {boosting.L2}::DOUBLE) + (g - gl) * (g - gl) / (h - hl + {boosting.L2}::DOUBLE) "
    f"- g * g / (h + {boosting.L2}::DOUBLE)) / 2, 6) + 0.0::DOUBLE AS gain FROM sides WHERE n_left >= 20 AND n - n_left >= 20",
)
def url_split_gains(spark: SparkSession, sf: str) -> DataFrame:
    """The gain of every split at the root of the first boosted tree, classes balanced, with L2."""
    rows = with_url_features(with_canonical_url(inputs.url_variants(spark, sf)))
    rows = stored(rows.select("label", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in URL_FEATURES]), "features")
    rows = terms.with_class_weight(rows)
    cuts = boosting.cutoffs(rows, URL_FEATURES)
    table = boosting.binned(rows, URL_FEATURES, cuts, "label", F.col("weight")).withColumn("margin", F.lit(0.0))
    sums = boosting.histogram(table, len(cuts), [], boosting.Tree([-1], [0.0], [0], [0.0]), 0)
    found = boosting.split_gains(sums, 20)
    # At most 42 times 31 cut-offs.
    names = [(f, b, URL_FEATURES[f], c) for f, own in enumerate(cuts) for b, c in enumerate(own)]
    named = F.broadcast(spark.createDataFrame(names, "f int, b int, name string, cut double"))
    found = found.join(named, (F.col("feature") == F.col("f")) & (F.col("bin") == F.col("b")))
    # Adding 0 makes a negative zero a plain one.
    return found.select(F.col("name").alias("feature"), "cut", "n_left", (F.round("gain", 6) + 0.0).alias("gain"))


# Bundles that SQL can state: one tree of one split, classes balanced; its leaves are Newton steps.
_STUMP_STEP = 0.5
_LEAF = "{s} * ({g}) / ({h} + " + f"{boosting.L2}::DOUBLE)"


def _stump_ctes(table: str, names: list[str]) -> list:
    """``p``: the rows of ``table`` with the probability of the fitted stump; after the gains."""
    values = "MAP {" + ", ".join(f"'{n}': round({n}, 6)::DOUBLE" for n in names) + "}"
    l2 = f"{boosting.L2}::DOUBLE"
    return [
        ("gains", f"SELECT *, round((gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})) / 2, 9) AS gain "
         "FROM sides WHERE n_left >= 20 AND n - n_left >= 20"),
        ("places", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(names)) + ") AS t(feature, place)"),
        ("best", "SELECT * FROM gains JOIN places USING (feature) ORDER BY gain DESC, place, cut LIMIT 1"),
        ("stump", "SELECT feature, cut, " + _LEAF.format(s=-_STUMP_STEP, g="gl", h="hl") + " AS below, "
         + _LEAF.format(s=-_STUMP_STEP, g="g - gl", h="h - hl") + " AS above FROM best"),
        ("p", f"SELECT f.*, 1 / (1 + exp(-(CASE WHEN ({values})[stump.feature] <= cut THEN below ELSE above END))) AS p FROM {table} f, stump"),
    ]


def _stump_bundle(spark: SparkSession, features: DataFrame, names: list[str]) -> PipelineModel:
    """A stump fitted on features and label, saved as a bundle and loaded."""
    rounded = [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]
    rows = terms.with_class_weight(stored(features.select("label", *rounded), "stump-features"))
    trees = boosting.boost(rows, names, weight="weight", iterations=1, depth=1, step=_STUMP_STEP)
    statement = "SELECT *, " + ", ".join(f"round({n}, 6) AS r_{n}" for n in names) + " FROM __THIS__"
    assembler = VectorAssembler(inputCols=[f"r_{n}" for n in names], outputCol="features")
    path = shared_dir(spark, "stump")
    writers.save_bundle(PipelineModel(stages=[SQLTransformer(statement=statement), assembler, trees]), path)
    return writers.load_bundle(path)


_STUMP = [*_GAIN_CTES, *_stump_ctes("url_features", URL_FEATURES), *_SCORED_URLS[-2:]]


@register("score_urls_stump", _STUMP, f"SELECT ordinal, {_score_urls_select('direct_url')} FROM t")
def score_urls_stump(spark: SparkSession, sf: str) -> DataFrame:
    """A boosted model fitted, saved and loaded as a bundle scores every URL, with all 14 columns."""
    rows = inputs.url_variants(spark, sf)
    model = _stump_bundle(spark, with_url_features(with_canonical_url(rows)), URL_FEATURES)
    return _flat_indicators(scoring.score_urls(rows, model=model).drop("raw_url", "label"))


_MESSAGE_STUMP = [
    *CLEAN_CHAIN, "links", "signals",
    ("labelled", "SELECT s.*, c.channel, c.label FROM signals s JOIN clean c USING (ordinal)"),
    *_gain_ctes("labelled", MESSAGE_FEATURES), *_stump_ctes("labelled", MESSAGE_FEATURES), *_SCORED_URLS[-2:],
]


@register("score_messages_stump", _MESSAGE_STUMP, f"SELECT {_score_messages_select()} FROM t")
def score_messages_stump(spark: SparkSession, sf: str) -> DataFrame:
    """A boosted model of the 21 signals fitted, saved and loaded as a bundle scores every message."""
    rows = _stored_text(spark, sf)
    model = _stump_bundle(spark, with_message_signals(rows, "cleaned_text"), MESSAGE_FEATURES)
    return scoring.score_messages(rows.select("ordinal", "channel", "cleaned_text"), "cleaned_text", model=model).drop("cleaned_text")


@register("score_urls_model")
def score_urls_model(spark: SparkSession, sf: str) -> DataFrame:
    """R14 with a fitted, calibrated bundle instead of the heuristic."""
    bundle = writers.load_bundle(_url_bundle(spark, sf))
    return _flat_indicators(scoring.score_urls(inputs.url_variants(spark, sf), model=bundle).drop("raw_url", "label"))


@register("score_messages_model")
def score_messages_model(spark: SparkSession, sf: str) -> DataFrame:
    """R15 with a fitted hybrid model."""
    splits = _message_split_table(spark, sf)
    model = training.fit_message_model(splits.filter(F.col("split") == "train"))
    rows = splits.select("ordinal", "channel", "cleaned_text")
    return scoring.score_messages(rows, "cleaned_text", model=model).drop("cleaned_text")


@register("model_tokens")
def model_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token attribution with the coefficients of a fitted text model, which number no more than its vocabulary."""
    splits = _message_split_table(spark, sf)
    model = training.fit_message_model(splits.filter(F.col("split") == "train"), "semantic")
    words, weights = model.stages[3].vocabulary, model.stages[-1].coefficients.toArray()
    coefficients = spark.createDataFrame(
        [(w, float(x)) for w, x in zip(words, weights)], "term string, coefficient double"
    )
    texts = training.with_model_text(splits).select("ordinal", "model_text")
    return terms.token_attribution(terms.tfidf(texts, "ordinal", "model_text", 768, True), coefficients, "ordinal")
