"""The registered queries. Each reads whole given tables; the SQL next to it is an independent statement of the result.

Conventions on both sides: integers and flags as BIGINT, doubles rounded to 6 digits, lists joined by ' | '.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import risk
from ..functions.chars import round_exact
from ..functions.fixed import CLEAN_COLUMNS, MESSAGE_FEATURES, QR_FAILED_COLUMNS, QR_FEATURES, QR_RAW_COLUMNS
from ..functions.fixed import MESSAGE_ADVICE, MESSAGE_CLEAN_SENTENCE, MESSAGE_LINK_SENTENCES, MESSAGE_POLICY
from ..functions.fixed import MESSAGE_SIGNAL_SENTENCES, MESSAGE_STATISTICAL_SENTENCE, MESSAGE_UPPERCASE_SENTENCE
from ..functions.fixed import MESSAGE_TARGETS, QR_URL_COLUMNS, URL_FEATURES, URL_INDICATORS, URL_KEYWORDS, URL_POLICY
from ..functions.fixed import URL_SUITES
from ..functions.qr import with_extracted_url
from ..functions.signals import message_vector, with_message_signals
from ..functions.text import channel_prefixed, template_skeleton, with_channel, with_message_stats
from ..functions.urls import char_decode, char_ids, root_domain, shannon_entropy, url_vector, with_canonical_url
from ..functions.urls import with_url_features
from ..operators import metrics, quality, terms
from ..operators.dedup import cluster_templates, keep_first, keep_first_numbered, template_stats
from ..operators.joins import leaked_keys, map_external_label, members, non_members
from ..operators.ordering import formatted_id
from ..operators.splits import balanced_sample, split_sizes, stratified_parts
from ..plans import messages as message_jobs
from ..plans import qr as qr_jobs
from ..plans import scoring
from ..plans import urls as url_jobs
from ..session import stored
from ..sources.readers import capped_scan, pending_files, qr_payloads
from ..sources.writers import route_decodes, successful_urls
from . import inputs, sql
from .sql import CLEAN_CHAIN, SIGNALS, URL_FEATURE_SQL, URL_SPLIT_CHAIN, big, dbl, lit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Bring a result into the form that both sides share."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, T.BooleanType):
            c = c.cast("int").cast("long")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, " | ")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegerType):
            c = F.array_join(c.cast("array<string>"), " ")
        out.append(c.alias(field.name))
    return df.select(*out)


def register(name: str, ctes: list | None = None, select: str | None = None):
    """Register a query; with ``select``, its oracle too."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf: finish(build(spark, sf))
        if select is not None:
            ORACLES[name] = sql.query(ctes or [], select)
        return build

    return add


# --- messages ------------------------------------------------------------------------------------

_STATS_SELECT = {
    "message_length": big("message_length"),
    "word_count": big("word_count"),
    "has_url": big("url_count > 0"),
    "url_count": big("url_count"),
    "has_phone": big("has_phone"),
    "has_email_header": big("has_email_header"),
    "uppercase_ratio": dbl(sql.round_even("upper_share", 4)),
    "special_char_ratio": dbl(sql.round_even("special_share", 4)),
}


def _aliased(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


@register(
    "clean_messages",
    [*CLEAN_CHAIN, "stats"],
    "SELECT 'MSG_' || lpad(CAST(number AS VARCHAR), 6, '0') AS message_id, channel, CAST(label AS BIGINT) AS label, "
    "CASE WHEN label = 1 THEN 'Phishing' ELSE 'Legitimate' END AS label_name, cleaned_text, raw_text, "
    f"{_aliased(_STATS_SELECT)} FROM stats",
)
def clean_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, purge, deduplicate, tag, measure, number."""
    return message_jobs.clean_messages(inputs.raw_messages(spark, sf)).select(CLEAN_COLUMNS)


@register(
    "channel_quality",
    [*CLEAN_CHAIN, "stats", ("r", f"SELECT *, {sql.round_even('upper_share', 4)} AS u, {sql.round_even('special_share', 4)} AS s FROM stats")],
    "SELECT channel, CAST(count(*) AS BIGINT) AS messages, CAST(sum(label) AS BIGINT) AS phishing, "
    "round(avg(message_length), 6) AS mean_length, round(avg(word_count), 6) AS mean_words, round(avg(u), 6) AS mean_uppercase, "
    "round(avg(s), 6) AS mean_special, CAST(sum(url_count) AS BIGINT) AS links FROM r GROUP BY channel",
)
def channel_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the whole cleaning job, summed up per channel."""
    clean = message_jobs.clean_messages(inputs.raw_messages(spark, sf))
    return clean.groupBy("channel").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("label").alias("phishing"),
        F.avg("message_length").alias("mean_length"),
        F.avg("word_count").alias("mean_words"),
        F.avg("uppercase_ratio").alias("mean_uppercase"),
        F.avg("special_char_ratio").alias("mean_special"),
        F.sum("url_count").cast("long").alias("links"),
    )


@register(
    "purge_counts",
    CLEAN_CHAIN[:3],
    "SELECT coalesce(purge_reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS \"rows\" FROM tagged GROUP BY 1",
)
def purge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.purge_counts(message_jobs.tag_messages(inputs.raw_messages(spark, sf)))


@register(
    "channel_mix",
    CLEAN_CHAIN,
    "SELECT channel, CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS \"rows\", "
    "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM clean GROUP BY channel, label",
)
def channel_mix(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distribution(_clean_text(spark, sf), "channel", "label")


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that were not purged (ordinal, label, cleaned_text), stored: deduplication reads them twice."""
    kept = message_jobs.kept_messages(inputs.raw_messages(spark, sf))
    return stored(kept.select("ordinal", "label", "cleaned_text"), "kept")


def _clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct clean messages (ordinal, label, cleaned_text, channel), without statistics and ids."""
    return with_channel(keep_first(_kept(spark, sf), "cleaned_text", "ordinal"))


def _stored_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stored table, for operators that read their input several times."""
    return stored(_clean_text(spark, sf), "clean")


@register(
    "message_stats",
    [*CLEAN_CHAIN[:3], ("clean", "SELECT * FROM tagged WHERE purge_reason IS NULL"), "stats"],
    f"SELECT ordinal, {_aliased(_STATS_SELECT)} FROM stats",
)
def message_stats(spark: SparkSession, sf: str) -> DataFrame:
    kept = message_jobs.kept_messages(inputs.raw_messages(spark, sf))
    return with_message_stats(kept).select("ordinal", *_STATS_SELECT)


@register(
    "dq_audit",
    CLEAN_CHAIN[:3],
    "SELECT n AS \"rows\", round(c, 6) AS completeness, round(u, 6) AS uniqueness, round(v, 6) AS validity, "
    "round(100.0::DOUBLE, 6) AS channel_validity, round((c + u + v + 100.0::DOUBLE) / 4, 6) AS overall FROM ("
    "SELECT CAST(count(*) AS BIGINT) AS n, count(cleaned_text) * 100.0::DOUBLE / count(*) AS c, "
    "count(DISTINCT cleaned_text) * 100.0::DOUBLE / count(*) AS u, "
    "sum(CASE WHEN length(cleaned_text) >= 3 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS v "
    "FROM tagged WHERE purge_reason IS NULL)",
)
def dq_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit before deduplication, so that uniqueness says something."""
    kept = with_channel(message_jobs.kept_messages(inputs.raw_messages(spark, sf)))
    return quality.quality_audit(kept.withColumn("message_length", F.length("cleaned_text")))


@register("dedup_first", CLEAN_CHAIN[:4], "SELECT ordinal, CAST(label AS BIGINT) AS label, md5(cleaned_text) AS text_digest FROM kept")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    first = keep_first(_kept(spark, sf), "cleaned_text", "ordinal")
    return first.select("ordinal", "label", F.md5("cleaned_text").alias("text_digest"))


@register(
    "message_ids",
    CLEAN_CHAIN,
    "SELECT ordinal, 'MSG_' || lpad(CAST(number AS VARCHAR), 6, '0') AS message_id FROM clean",
)
def message_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = keep_first_numbered(_kept(spark, sf), "cleaned_text", "ordinal", "number")
    return rows.select("ordinal", formatted_id("MSG", F.col("number")).alias("message_id"))


@register(
    "cyber_features",
    [*CLEAN_CHAIN, "links", "signals"],
    "SELECT ordinal, " + ", ".join(f"{dbl(n)} AS {n}" for n in SIGNALS) + " FROM signals",
)
def cyber_features(spark: SparkSession, sf: str) -> DataFrame:
    return with_message_signals(keep_first(_kept(spark, sf), "cleaned_text", "ordinal")).select("ordinal", *MESSAGE_FEATURES)


@register("template_skeleton", [*CLEAN_CHAIN, "skeletons"], "SELECT ordinal, template_skeleton FROM skeletons")
def template_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_text(spark, sf).select("ordinal", template_skeleton(F.col("cleaned_text")).alias("template_skeleton"))


@register(
    "template_clusters",
    [*CLEAN_CHAIN, "skeletons", "templates"],
    "SELECT s.ordinal, CAST(t.template_id AS BIGINT) AS template_id FROM skeletons s JOIN templates t USING (template_skeleton)",
)
def template_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_templates(_stored_text(spark, sf)).select("ordinal", "template_id")


@register(
    "template_stats",
    [*CLEAN_CHAIN, "skeletons", "templates"],
    "SELECT CAST(template_id AS BIGINT) AS template_id, CAST(size AS BIGINT) AS size, CAST(label AS BIGINT) AS label, channel FROM templates",
)
def template_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clean_text(spark, sf).withColumn("template_skeleton", template_skeleton(F.col("cleaned_text")))
    return template_stats(rows).select("template_id", "size", "label", "channel")


_SPLIT_CHAIN = [*CLEAN_CHAIN, "skeletons", "templates", "template_order", "test_b", "message_splits"]


@register("template_split", _SPLIT_CHAIN, "SELECT ordinal, split FROM message_splits")
def template_split(spark: SparkSession, sf: str) -> DataFrame:
    """Leak-free message splits."""
    return message_jobs.message_splits(_stored_text(spark, sf)).select("ordinal", "split")


@register(
    "split_sizes",
    _SPLIT_CHAIN,
    "SELECT split, CAST(count(*) AS BIGINT) AS \"rows\", round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent "
    "FROM message_splits GROUP BY split",
)
def message_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return split_sizes(message_jobs.message_splits(_stored_text(spark, sf)))


@register(
    "template_leaks",
    _SPLIT_CHAIN,
    "SELECT DISTINCT md5(template_skeleton) AS digest FROM message_splits WHERE split = 'test_b' AND template_skeleton IN "
    "(SELECT template_skeleton FROM message_splits WHERE split = 'train') "
    "UNION ALL SELECT 'train rows: ' || CAST(count(*) AS VARCHAR) FROM message_splits WHERE split = 'train'",
)
def template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Templates on both sides of the split: none, so the only row is the size of the training set."""
    rows = message_jobs.message_splits(_stored_text(spark, sf))
    rows = rows.withColumn("digest", F.md5(template_skeleton(F.col("cleaned_text"))))
    train = rows.filter(F.col("split") == "train")
    leaks = leaked_keys(train, rows.filter(F.col("split") == "test_b"), "digest")
    count = train.agg(F.concat(F.lit("train rows: "), F.count(F.lit(1)).cast("string")).alias("digest"))
    return leaks.unionByName(count)


@register(
    "stratified_split",
    CLEAN_CHAIN,
    "SELECT ordinal, CASE WHEN place <= floor(members * 0.25::DOUBLE) THEN 'test' "
    "WHEN place <= floor(members * 0.25::DOUBLE) + floor(members * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM ("
    "SELECT ordinal, row_number() OVER (PARTITION BY channel, label ORDER BY md5('42:' || ordinal)) AS place, "
    "count(*) OVER (PARTITION BY channel, label)::DOUBLE AS members FROM clean)",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"test": 0.25, "validation": 0.15}
    rows = stratified_parts(_stored_text(spark, sf), ["channel", "label"], "ordinal", parts, rest="train")
    return rows.select("ordinal", "split")


@register(
    "holdout_anti_join",
    ["external", "holdout"],
    "SELECT ordinal, CAST(label AS BIGINT) AS label, CASE WHEN label = 1 THEN 'Phishing' ELSE 'Legitimate' END AS label_name, "
    "'SMS' AS channel, md5(cleaned_text) AS text_digest FROM holdout",
)
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    """External holdout."""
    rows = message_jobs.external_holdout(inputs.external_messages(spark, sf), inputs.master_messages(spark, sf))
    return rows.select("ordinal", "label", "label_name", "channel", F.md5("cleaned_text").alias("text_digest"))


@register(
    "label_map",
    ["external"],
    "SELECT ordinal, CAST(CASE final_label WHEN 'ham' THEN 0 ELSE 1 END AS BIGINT) AS label FROM external "
    "WHERE final_label IN ('ham', 'spam', 'smishing')",
)
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    return map_external_label(inputs.external_messages(spark, sf)).select("ordinal", "label")


@register(
    "label_members",
    [],
    "SELECT doc_id, 'in' AS side FROM documents WHERE source IN (SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1) "
    "UNION ALL SELECT doc_id, 'out' FROM documents WHERE source NOT IN "
    "(SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)",
)
def label_members(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose source holds a toxic document, and the others."""
    documents = inputs.table(spark, sf, "documents").select("doc_id", "source")
    toxic = inputs.table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    marked = documents.join(toxic, "doc_id", "left_semi").select("source")
    inside = members(documents, marked, "source").withColumn("side", F.lit("in"))
    outside = non_members(documents, marked, "source").withColumn("side", F.lit("out"))
    return inside.unionByName(outside).select("doc_id", "side")


# --- URLs ----------------------------------------------------------------------------------------

_CANON = ["variants", *sql.canonical("variants", "ordinal, label")]


@register(
    "canonical_url",
    _CANON,
    "SELECT ordinal, original_url, normalized_url, scheme, domain, path, query, fragment FROM canonical",
)
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_canonical_url(inputs.url_variants(spark, sf))
    return rows.drop("raw_url", "label")


@register("root_domain", _CANON, f"SELECT ordinal, domain, {sql.root_domain('domain')} AS root_domain FROM canonical")
def root_domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_canonical_url(inputs.url_variants(spark, sf))
    return rows.select("ordinal", "domain", root_domain(F.col("domain")).alias("root_domain"))


@register("url_entropy", ["variants"], f"SELECT ordinal, {dbl(sql.entropy('raw_url'))} AS entropy FROM variants")
def url_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.url_variants(spark, sf).select("ordinal", shannon_entropy(F.col("raw_url")).alias("entropy"))


@register(
    "url_features",
    [*_CANON, "url_parts", "url_features"],
    "SELECT ordinal, " + ", ".join(f"{dbl(n)} AS {n}" for n in URL_FEATURE_SQL) + " FROM url_features",
)
def url_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_url_features(with_canonical_url(inputs.url_variants(spark, sf)))
    return rows.select("ordinal", *URL_FEATURES)


@register(
    "char_ids",
    ["variants"],
    "SELECT ordinal, array_to_string(list_transform(generate_series(1, 150), lambda i: CASE WHEN i > length(raw_url) THEN 0 "
    "WHEN unicode(substr(raw_url, i, 1)) BETWEEN 32 AND 126 THEN unicode(substr(raw_url, i, 1)) - 28 ELSE 1 END), ' ') AS ids, "
    "regexp_replace(substr(raw_url, 1, 150), '[^ -~]', '<UNK>', 'g') AS decoded FROM variants",
)
def character_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.url_variants(spark, sf).select("ordinal", char_ids(F.col("raw_url")).alias("ids"))
    return rows.withColumn("decoded", char_decode(F.col("ids")))


_QR = ["decodes", "extracted", "qr_urls"]


@register(
    "extract_url",
    _QR,
    "SELECT ordinal, nullif(normalized_url, '') AS normalized_url, content, content_type FROM qr_urls",
)
def extract_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_extracted_url(inputs.qr_decodes(spark, sf))
    return rows.select("ordinal", "normalized_url", "content", "content_type")


def _qr_column(name: str) -> str:
    texts = {"qr_id", "image_filename", "image_path", "source_folder", "decoded_content", "normalized_url", "content_type",
             "decode_status", "domain", "decode_error"}
    return name if name in texts else f"CAST({name} AS BIGINT) AS {name}"


@register(
    "qr_url_features",
    [*_QR, "qr_raw"],
    "SELECT ordinal, " + ", ".join(_qr_column(c) for c in QR_FEATURES) + " FROM qr_raw",
)
def qr_url_features(spark: SparkSession, sf: str) -> DataFrame:
    return qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)).select("ordinal", *QR_FEATURES)


def _stored_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The decode table as a stored one: payloads are parsed once, and filters reach the files."""
    return stored(qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)), "raw")


def _row_digest(columns: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])).alias("row_digest")


def row_digest_sql(columns: list[str]) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + ")) AS row_digest"


ROUTED_SQL = (
    f"SELECT 'raw' AS target, {row_digest_sql(QR_RAW_COLUMNS)} FROM qr_raw "
    f"UNION ALL SELECT 'urls', {row_digest_sql(QR_URL_COLUMNS)} FROM qr_raw WHERE decode_status = 'success' AND content_type = 'url' "
    f"UNION ALL SELECT 'failed', {row_digest_sql(QR_FAILED_COLUMNS)} FROM qr_raw WHERE decode_status = 'failed'"
)


def routed_digests(parts: dict[str, DataFrame]) -> DataFrame:
    """(target, row_digest) of every row of the three tables."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("target"), _row_digest(part.columns))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("route_decodes", [*_QR, "qr_raw"], ROUTED_SQL)
def route(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the three views of the decode table."""
    return routed_digests(route_decodes(_stored_raw(spark, sf)))


@register(
    "qr_raw_table",
    [*_QR, "qr_raw"],
    "SELECT " + ", ".join(_qr_column(c) for c in QR_RAW_COLUMNS) + " FROM qr_raw",
)
def qr_raw_table(spark: SparkSession, sf: str) -> DataFrame:
    """C4: the full decode table."""
    return qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)).select(QR_RAW_COLUMNS)


@register(
    "rederived_status",
    [*_QR, "qr_raw"],
    "SELECT ordinal, decode_status, content_type, CASE WHEN decode_status = 'failed' THEN 'decode_failed' ELSE '' END AS decode_error, "
    "CAST(length(normalized_url) AS BIGINT) AS url_length FROM (SELECT ordinal, normalized_url, "
    "CASE WHEN normalized_url <> '' OR decoded_content <> '' THEN 'success' ELSE 'failed' END AS decode_status, "
    "CASE WHEN normalized_url <> '' THEN 'url' WHEN decoded_content <> '' THEN 'non_url' ELSE 'unknown' END AS content_type FROM qr_raw)",
)
def rederived_status(spark: SparkSession, sf: str) -> DataFrame:
    raw = qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)).drop("decode_status", "content_type", "decode_error", "url_length")
    return qr_jobs.rederive_status(raw).select("ordinal", "decode_status", "content_type", "decode_error", "url_length")


@register(
    "duplicate_report",
    [*_QR, "qr_raw"],
    "SELECT normalized_url, CAST(count(*) AS BIGINT) AS occurrence_count, CAST(sum(1 - label) AS BIGINT) AS benign_count, "
    "CAST(sum(label) AS BIGINT) AS malicious_count, CAST(CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN 1 ELSE 0 END AS BIGINT) "
    "AS is_cross_label_conflict, array_to_string(list(image_filename ORDER BY ordinal)[1:5], ';') AS sample_image_filenames "
    "FROM qr_raw WHERE decode_status = 'success' AND content_type = 'url' GROUP BY normalized_url HAVING count(*) > 1",
)
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_report(successful_urls(_stored_raw(spark, sf)))


_IS_URL = "decode_status = 'success' AND content_type = 'url'"
_DECODE_STATS = {
    "total_images": "count(*)",
    "malicious_images": "count(*) FILTER (label = 1)",
    "benign_images": "count(*) FILTER (label = 0)",
    "successful_decodes": "count(*) FILTER (decode_status = 'success')",
    "failed_decodes": "count(*) FILTER (decode_status <> 'success')",
    "successful_malicious": "count(*) FILTER (decode_status = 'success' AND label = 1)",
    "successful_benign": "count(*) FILTER (decode_status = 'success' AND label = 0)",
    "decoded_urls": f"count(*) FILTER ({_IS_URL})",
    "decoded_non_urls": "count(*) FILTER (decode_status = 'success' AND content_type <> 'url')",
    **{name: f"count(*) FILTER ({_IS_URL} AND {flag} = 1)" for flag, name in quality.FLAGS.items()},
    "unique_urls": f"count(DISTINCT normalized_url) FILTER ({_IS_URL})",
    "duplicate_urls": f"(SELECT count(*) FROM (SELECT 1 FROM qr_raw WHERE {_IS_URL} GROUP BY normalized_url HAVING count(*) > 1))",
    "unique_domains": f"count(DISTINCT domain) FILTER ({_IS_URL} AND domain <> '')",
}
_RATES = {
    "overall_decode_rate": ("successful_decodes", "total_images"),
    "malicious_decode_rate": ("successful_malicious", "malicious_images"),
    "benign_decode_rate": ("successful_benign", "benign_images"),
}


_DECODE_CTE = ("s", "SELECT " + ", ".join(f"{big(v)} AS {k}" for k, v in _DECODE_STATS.items()) + " FROM qr_raw")
_RATE_COLUMNS = ", ".join(
    f"coalesce(round({a} * 100.0::DOUBLE / nullif({b}, 0), 6), 0.0) AS {k}" for k, (a, b) in _RATES.items()
)


@register("decode_stats", [*_QR, "qr_raw", _DECODE_CTE], f"SELECT *, {_RATE_COLUMNS} FROM s")
def decode_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.decode_statistics(qr_jobs.qr_raw_table(inputs.qr_decodes(spark, sf)))


@register(
    "pending_files",
    [*_QR, "qr_raw"],
    "SELECT qr_id, image_filename FROM qr_raw WHERE image_filename NOT IN "
    "(SELECT image_filename FROM qr_raw WHERE decode_status = 'success')",
)
def pending(spark: SparkSession, sf: str) -> DataFrame:
    """Files still to decode, given the successful rows as the table of what is done."""
    decodes = inputs.qr_decodes(spark, sf)
    done = decodes.filter(F.col("payload").isNotNull()).select("image_filename")
    return pending_files(decodes.select("qr_id", "image_filename"), done)


@register(
    "qr_payloads",
    [*_QR, "qr_raw"],
    f"SELECT ordinal, {sql.strip('coalesce(nullif(decoded_content, {}), nullif(normalized_url, {}))'.format(lit(''), lit('')))} AS raw_url, "
    "CAST(label AS BIGINT) AS label, 'qr_decoded' AS source FROM qr_raw WHERE decoded_content <> '' OR normalized_url <> ''",
)
def payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Payload rows of both tables, malicious and benign."""
    raw = _stored_raw(spark, sf)
    return qr_payloads(raw.filter("label = 1"), 1).unionByName(qr_payloads(raw.filter("label = 0"), 0))


@register(
    "capped_scan",
    ["sources"],
    "SELECT raw_url, CAST(label AS BIGINT) AS label, source, ordinal FROM (SELECT *, row_number() OVER "
    "(PARTITION BY source, label ORDER BY ordinal) AS place FROM sources) WHERE place <= 50",
)
def capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows per source and label; the cap is the operator."""
    return capped_scan(inputs.url_sources(spark, sf), 50).select("raw_url", "label", "source", "ordinal")


_CORPUS = ["sources", *sql.canonical("sources", "raw_url, ordinal, label, source")]


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return url_jobs.url_corpus(inputs.url_sources(spark, sf))


def _stored_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return stored(_corpus(spark, sf), "corpus")


@register(
    "url_corpus",
    [*_CORPUS, "corpus"],
    "SELECT raw_url, normalized_url, domain, root_domain, CAST(label AS BIGINT) AS label, source FROM corpus",
)
def url_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Unified URL corpus, without a cap."""
    return _corpus(spark, sf)


@register("domain_split", [*_CORPUS, *URL_SPLIT_CHAIN], "SELECT normalized_url, split FROM url_splits")
def domain_split(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-leak URL splits."""
    return url_jobs.url_splits(_stored_corpus(spark, sf)).select("normalized_url", "split")


@register(
    "balanced_sample",
    [*_CORPUS, *URL_SPLIT_CHAIN],
    "SELECT normalized_url, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY label "
    "ORDER BY md5('42:' || normalized_url)) AS place, (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1), 250) "
    "FROM url_splits WHERE split = 'test_random' AND length(normalized_url) > 35) AS n FROM url_splits "
    "WHERE split = 'test_random' AND length(normalized_url) > 35) WHERE place <= n",
)
def temporal(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced sample of the long URLs in the random test set."""
    splits = stored(url_jobs.url_splits(_stored_corpus(spark, sf)), "splits")
    return url_jobs.temporal_sample(splits, url_jobs.TEMPORAL_ROWS).select("normalized_url", "label")


@register(
    "balanced_corpus",
    [*_CORPUS, "corpus"],
    "SELECT normalized_url, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY label "
    "ORDER BY md5('42:' || normalized_url)) AS place, (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) "
    "FROM corpus) AS n FROM corpus) WHERE place <= n",
)
def balanced_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """W5 on the whole corpus: all of the smaller class, as many of the other."""
    return balanced_sample(_stored_corpus(spark, sf), "normalized_url", cap=None).select("normalized_url", "label")


@register(
    "leak_check",
    [*_CORPUS, *URL_SPLIT_CHAIN],
    "SELECT split, CAST(count(DISTINCT root_domain) AS BIGINT) AS domains, CAST(count(DISTINCT CASE WHEN root_domain IN "
    "(SELECT root_domain FROM url_splits WHERE split = 'train') THEN root_domain END) AS BIGINT) AS shared_with_train "
    "FROM url_splits GROUP BY split",
)
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Root domains per split and how many of them occur in the training set."""
    pairs = url_jobs.url_splits(_stored_corpus(spark, sf)).select("split", "root_domain").distinct()
    train = pairs.filter(F.col("split") == "train").select("root_domain", F.lit(1).alias("in_train"))
    return pairs.join(train, "root_domain", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("domains"), F.coalesce(F.sum("in_train"), F.lit(0)).alias("shared_with_train")
    )


# --- metrics -------------------------------------------------------------------------------------

_CELLS = ("count(*) FILTER (label = 1 AND pred = 1) AS TP, count(*) FILTER (label = 0 AND pred = 1) AS FP, "
          "count(*) FILTER (label = 0 AND pred = 0) AS TN, count(*) FILTER (label = 1 AND pred = 0) AS FN")


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0::DOUBLE)"


_MACRO = {
    "accuracy": f"({_div('TP + TN', 'TP + FP + TN + FN')} * 100.0::DOUBLE)",
    "macro_f1": f"(({_div('2 * TP', '2 * TP + FP + FN')} + {_div('2 * TN', '2 * TN + FP + FN')}) / 2 * 100.0::DOUBLE)",
    "macro_precision": f"(({_div('TP', 'TP + FP')} + {_div('TN', 'TN + FN')}) / 2 * 100.0::DOUBLE)",
    "macro_recall": f"(({_div('TP', 'TP + FN')} + {_div('TN', 'TN + FP')}) / 2 * 100.0::DOUBLE)",
}


@register(
    "confusion",
    ["scored"],
    f"SELECT channel, split, {_CELLS} FROM scored GROUP BY channel, split",
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(inputs.scored_rows(spark, sf), "channel", "split")


_MATRIX_CTES = [
    "scored",
    ("levels", "SELECT 'Overall Master Test Set' AS level, * FROM scored WHERE split <> 'test_c' "
     "UNION ALL SELECT 'Channel: ' || channel, * FROM scored WHERE split <> 'test_c' "
     "UNION ALL SELECT CASE split WHEN 'test_a' THEN 'Test A (Standard Stratified)' WHEN 'test_b' THEN 'Test B (Unseen Templates)' "
     "ELSE 'Test C (External Unseen Dataset)' END, * FROM scored"),
    ("cells", f"SELECT level, {_CELLS} FROM levels GROUP BY level"),
    ("figures", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _MACRO.items()) + " FROM cells"),
    ("targets", "SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {v}::DOUBLE)" for k, v in MESSAGE_TARGETS.items())
     + ") AS t(level, goal)"),
]
_MATRIX_SELECT = (
    "SELECT level, TP + FP + TN + FN AS samples, "
    + ", ".join(f"{dbl(sql.round_even(k, 2))} AS {k}" for k in _MACRO)
    + ", '>= ' || printf('%.1f', goal) || '%' AS target, CASE WHEN accuracy >= goal - 2.5::DOUBLE THEN 'PASS' ELSE 'EVAL' END AS status, "
    "TP, FP, TN, FN FROM figures JOIN targets USING (level)"
)


@register("metrics_matrix", _MATRIX_CTES, _MATRIX_SELECT)
def metrics_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.message_matrix(inputs.scored_rows(spark, sf))


_AUC = (
    "SELECT {g}, CASE WHEN p > 0 AND n > 0 THEN (rank_sum - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n) ELSE 0 END AS auc FROM ("
    "SELECT {g}, sum(CASE WHEN label = 1 THEN mid END)::DOUBLE AS rank_sum, count(*) FILTER (label = 1) AS p, "
    "count(*) FILTER (label = 0) AS n FROM (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY prob) + "
    "(count(*) OVER (PARTITION BY {g}, prob) - 1) / 2.0::DOUBLE AS mid FROM scored) GROUP BY {g})"
)
_ECE = (
    "SELECT {g}, sum(n * abs(acc - conf)) / sum(n) AS ece, sum(sq) / sum(n) AS brier FROM (SELECT {g}, "
    "list_sum(list_transform(generate_series(1, 9), lambda i: CASE WHEN prob >= i * 0.1::DOUBLE THEN 1 ELSE 0 END)) AS bin, "
    "count(*)::DOUBLE AS n, avg(label::DOUBLE) AS acc, avg(prob) AS conf, sum((prob - label) * (prob - label)) AS sq FROM scored GROUP BY 1, 2) GROUP BY {g}"
)


@register("roc_auc", ["scored", ("a", _AUC.format(g="split"))], "SELECT split, round(auc, 6) AS roc_auc FROM a")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(inputs.scored_rows(spark, sf), "split")


@register("ece", ["scored", ("e", _ECE.format(g="split"))], "SELECT split, round(ece, 6) AS ece FROM e")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calibration_error(inputs.scored_rows(spark, sf), "split").select("split", "ece")


@register("brier", ["scored"], "SELECT split, round(avg((prob - label) * (prob - label)), 6) AS brier FROM scored GROUP BY split")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calibration_error(inputs.scored_rows(spark, sf), "split").select("split", "brier")


_BINARY = {
    "accuracy": _MACRO["accuracy"],
    "precision": f"({_div('TP', 'TP + FP')} * 100.0::DOUBLE)",
    "recall": f"({_div('TP', 'TP + FN')} * 100.0::DOUBLE)",
    "f1": f"({_div('2 * TP', '2 * TP + FP + FN')} * 100.0::DOUBLE)",
}


_SUITE_CTES = [
        "scored",
        ("a", _AUC.format(g="suite")),
        ("e", _ECE.format(g="suite")),
        ("cells", f"SELECT suite, {_CELLS} FROM scored GROUP BY suite"),
        ("figures", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _BINARY.items()) + ", ece * 100.0::DOUBLE AS ece_percent "
         "FROM cells JOIN a USING (suite) JOIN e USING (suite)"),
    ]
_SUITE_SELECT = (
    "SELECT suite, CASE suite " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in URL_SUITES.items()) + " END AS title, "
    "TP + FP + TN + FN AS samples, "
    + ", ".join(f"{dbl(sql.round_even(k, 2))} AS {k}" for k in _BINARY)
    + f", {dbl(sql.round_even('auc', 4))} AS roc_auc, {dbl(sql.round_even('ece_percent', 2))} AS ece, "
    f"CASE WHEN {sql.round_even('f1', 2)} >= 90 THEN 'PASS' ELSE 'INVESTIGATE' END AS status, TP, FP, TN, FN FROM figures"
)


@register("url_suite_matrix", _SUITE_CTES, _SUITE_SELECT)
def url_suite_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.url_suite_matrix(inputs.scored_rows(spark, sf))


@register(
    "stage_pivot",
    [
        "scored",
        ("staged", "SELECT label, split, stage, CASE WHEN prob >= cut THEN 1 ELSE 0 END AS pred FROM scored, "
         "(VALUES ('Stage 1', 0.4::DOUBLE), ('Stage 2', 0.5::DOUBLE), ('Stage 3', 0.6::DOUBLE)) AS s(stage, cut)"),
        ("cells", f"SELECT stage, split, {_CELLS} FROM staged GROUP BY stage, split"),
        ("figures", f"SELECT *, {_MACRO['accuracy']} AS accuracy, {_MACRO['macro_f1']} AS macro_f1 FROM cells"),
    ],
    "SELECT stage, "
    + ", ".join(
        f"max({dbl(sql.round_even(k, 2))}) FILTER (split = '{s}') AS {s}_{k}"
        for s in ("test_a", "test_b") for k in ("accuracy", "macro_f1")
    )
    + " FROM figures GROUP BY stage",
)
def stage_pivot(spark: SparkSession, sf: str) -> DataFrame:
    cuts = F.array(
        *[F.struct(F.lit(f"Stage {i}").alias("stage"), F.lit(c).alias("cut")) for i, c in enumerate((0.4, 0.5, 0.6), 1)]
    )
    rows = inputs.scored_rows(spark, sf).select("label", "split", "prob", F.inline(cuts))
    return metrics.stage_comparison(rows.withColumn("pred", (F.col("prob") >= F.col("cut")).cast("int")))


# --- risk, scoring, explanation -------------------------------------------------------------------

_URL_PROB = ("least(0.99::DOUBLE, 0.05::DOUBLE + CASE WHEN has_ip_host = 1 THEN 0.45::DOUBLE ELSE 0 END "
             "+ CASE WHEN has_suspicious_tld = 1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN has_shortener = 1 THEN 0.2::DOUBLE ELSE 0 END "
             "+ CASE WHEN has_login_kw = 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN has_brand_kw = 1 THEN 0.3::DOUBLE ELSE 0 END)")
_TIER = ("CASE WHEN {s} <= 24 THEN 'LOW' WHEN {s} <= 49 THEN 'MEDIUM' WHEN {s} <= 79 THEN 'HIGH' ELSE 'CRITICAL' END")
_RISK = "CAST(round_even({p} * 100.0::DOUBLE, 0) AS BIGINT)"


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END"


@register(
    "heuristic_url_score",
    [*_CANON, "url_parts", "url_features"],
    f"SELECT ordinal, {dbl(_URL_PROB)} AS probability FROM url_features",
)
def heuristic_url_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_url_features(with_canonical_url(inputs.url_variants(spark, sf)))
    return rows.select("ordinal", risk.url_heuristic_score().alias("probability"))


@register(
    "risk_tiers",
    ["scored", ("r", f"SELECT *, {_RISK.format(p='prob')} AS risk_score FROM scored"),
     ("t", f"SELECT *, {_TIER.format(s='risk_score')} AS severity FROM r")],
    f"SELECT vec_id, {dbl(sql.round_even('prob', 4))} AS calibrated, risk_score, severity, "
    + ", ".join(f"{_case('severity', {k: v[i] for k, v in MESSAGE_POLICY.items()})} AS {n}" for i, n in ((1, 'action'), (2, 'status'), (3, 'color')))
    + f", {_case('severity', {k: v[0] for k, v in URL_POLICY.items()})} AS url_action, "
    f"{_case('severity', {k: v[1] for k, v in URL_POLICY.items()})} AS guidance, "
    "CASE WHEN risk_score >= 50 THEN 'MALICIOUS' ELSE 'BENIGN' END AS prediction FROM t",
)
def risk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """R3 (unfitted) to R8 on scored rows."""
    rows = inputs.scored_rows(spark, sf).withColumn("cal", risk.clip(F.col("prob")))
    rows = rows.withColumn("risk_score", risk.risk_score(F.col("cal")))
    rows = rows.withColumn("severity", risk.severity(F.col("risk_score")))
    url = risk.url_policy(F.col("severity"))
    return rows.select(
        "vec_id", round_exact(F.col("cal"), 4).alias("calibrated"), "risk_score", "severity",
        *[c.alias(n) for n, c in risk.message_policy(F.col("severity")).items()],
        url["action"].alias("url_action"), url["guidance"].alias("guidance"),
        risk.message_verdict(F.col("risk_score")).alias("prediction"),
    )


def _fill(text: str, value: str) -> str:
    """SQL concatenation for a template with one placeholder."""
    head, tail = re.split(r"%(?:s|d|\.2f)", text, maxsplit=1)
    return f"{lit(head)} || {value} || {lit(tail)}"


_INDICATOR_RULES = {
    "has_ip_host": ("has_ip_host = 1", "domain"),
    "has_shortener": ("has_shortener = 1", None),
    "has_suspicious_tld": ("has_suspicious_tld = 1", "string_split(domain, '.')[-1]"),
    "has_punycode": ("has_punycode = 1", None),
    "subdomain_count": ("subdomain_count >= 3", "CAST(CAST(subdomain_count AS BIGINT) AS VARCHAR)"),
    "url_entropy": ("url_entropy > 4.5", "printf('%.2f', " + sql.round_even("url_entropy", 2) + ")"),
    "is_https": ("is_https = 0", None),
    "consecutive_hyphens": ("consecutive_hyphens = 1", None),
    "has_login_kw": ("has_login_kw = 1", None),
    "has_brand_kw": ("has_brand_kw = 1", None),
}


def _indicator_sql(name: str, value: str | None) -> str:
    level, title, text = URL_INDICATORS[name]
    fill = lambda t: _fill(t, value) if value and "%" in t else lit(t)
    return f"{lit(level + ': ')} || {fill(title)} || ' - ' || {fill(text)}"


_ANY_RULE = " OR ".join(condition for condition, _ in _INDICATOR_RULES.values())
_INDICATORS = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN {_indicator_sql(n, v)} END" for n, (c, v) in _INDICATOR_RULES.items())
    + f", CASE WHEN NOT ({_ANY_RULE}) AND severity = 'LOW' THEN {_indicator_sql('clean', None)} END], lambda x: x IS NOT NULL), ' | ')"
)
_N_INDICATORS = "(" + " + ".join(f"CAST({c} AS INT)" for c, _ in _INDICATOR_RULES.values()) + ")"
_URL_TOKENS = (
    "array_to_string(list_filter([CASE WHEN has_ip_host = 1 THEN domain END, "
    "CASE WHEN has_suspicious_tld = 1 THEN '.' || string_split(domain, '.')[-1] END, "
    + ", ".join(f"CASE WHEN contains(low, {lit(k)}) THEN {lit(k)} END" for k in URL_KEYWORDS)
    + "], lambda x: x IS NOT NULL)[1:8], ' | ')"
)
_SCORED_URLS = [
    *_CANON, "url_parts", "url_features",
    ("p", f"SELECT *, {_URL_PROB} AS p FROM url_features"),
    ("r", f"SELECT *, {_RISK.format(p='p')} AS risk_score FROM p"),
    ("t", f"SELECT *, {_TIER.format(s='risk_score')} AS severity FROM r"),
]


def _flat_indicators(df: DataFrame) -> DataFrame:
    text = F.transform("indicators", lambda i: F.concat(i["level"], F.lit(": "), i["title"], F.lit(" - "), i["description"]))
    return df.withColumn("indicators", text)


@register("url_indicators", _SCORED_URLS, f"SELECT ordinal, severity, {_INDICATORS} AS indicators FROM t")
def url_indicators(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.score_urls(inputs.url_variants(spark, sf))
    return _flat_indicators(rows).select("ordinal", "severity", "indicators")


@register("suspicious_tokens", _SCORED_URLS, f"SELECT ordinal, {_URL_TOKENS} AS suspicious_tokens FROM t")
def url_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_urls(inputs.url_variants(spark, sf)).select("ordinal", "suspicious_tokens")


def _score_urls_select(source: str) -> str:
    return (
        f"original_url, normalized_url, domain, root AS root_domain, {lit(source)} AS source, "
        f"{dbl(sql.round_even('p', 4))} AS raw_p_malicious, {dbl(sql.round_even('p', 4))} AS calibrated_p_malicious, risk_score, severity, "
        f"{_case('severity', {k: v[0] for k, v in URL_POLICY.items()})} AS action, {_case('severity', {k: v[1] for k, v in URL_POLICY.items()})} AS guidance, "
        f"{_INDICATORS} AS indicators, {_URL_TOKENS} AS suspicious_tokens, "
        f"CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'Flagged as ' || severity || ' Risk (' || risk_score || '/100) due to ' || {_N_INDICATORS} || "
        "' structural anomalies and phishing indicators.' WHEN severity = 'MEDIUM' THEN 'Moderate suspicion (' || risk_score || "
        "'/100). Exercise caution before interacting with this destination.' ELSE 'Clean URL (' || risk_score || "
        "'/100). Characteristics align with normal benign web traffic.' END AS explanation"
    )


@register("score_urls", _SCORED_URLS, f"SELECT ordinal, {_score_urls_select('direct_url')} FROM t")
def score_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.score_urls(inputs.url_variants(spark, sf)).drop("raw_url", "label")
    return _flat_indicators(rows)


_MSG_PROB = "0.05::DOUBLE + CASE WHEN has_shortened_url = 1 THEN 0.25::DOUBLE ELSE 0 END"
_MSG_PROB_INTENDED = (
    "least(0.99::DOUBLE, 0.05::DOUBLE + CASE WHEN urgency_score > 0 THEN 0.35::DOUBLE ELSE 0 END "
    "+ CASE WHEN account_threat = 1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN credential_request = 1 THEN 0.3::DOUBLE ELSE 0 END "
    "+ CASE WHEN has_shortened_url = 1 THEN 0.25::DOUBLE ELSE 0 END)"
)


def _scored_messages(prob: str) -> list:
    return [
        *CLEAN_CHAIN, "links", "signals",
        ("p", f"SELECT s.*, c.channel, {prob} AS p FROM signals s JOIN clean c USING (ordinal)"),
        ("r", f"SELECT *, {_RISK.format(p='p')} AS risk_score FROM p"),
        ("t", f"SELECT *, {_TIER.format(s='risk_score')} AS severity FROM r"),
    ]


_LINK_CASE = "CASE " + " ".join(f"WHEN {k} > 0 THEN {lit(v)}" for k, v in MESSAGE_LINK_SENTENCES.items()) + " END"
_FIRED = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {k} > 0 THEN {lit(v)} END" for k, v in MESSAGE_SIGNAL_SENTENCES.items())
    + f", {_LINK_CASE}, CASE WHEN uppercase_ratio > 0.25 THEN {lit(MESSAGE_UPPERCASE_SENTENCE)} END], lambda x: x IS NOT NULL)"
)
_MSG_INDICATORS = (
    f"CASE WHEN len({_FIRED}) > 0 THEN array_to_string({_FIRED}, ' | ') WHEN severity = 'LOW' THEN {lit(MESSAGE_CLEAN_SENTENCE)} "
    f"ELSE {lit(MESSAGE_STATISTICAL_SENTENCE)} END"
)


@register("message_indicators", _scored_messages(_MSG_PROB_INTENDED), f"SELECT ordinal, severity, {_MSG_INDICATORS} AS indicators FROM t")
def message_indicators(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.score_messages(_clean_text(spark, sf), "cleaned_text", mode="intended")
    return rows.select("ordinal", "severity", "indicators")


def _score_messages_select() -> str:
    return (
        f"ordinal, channel, {dbl(sql.round_even('p', 4))} AS raw_probability, {dbl(sql.round_even('p', 4))} AS calibrated_probability, "
        f"risk_score, severity, {_case('severity', {k: v[1] for k, v in MESSAGE_POLICY.items()})} AS action, "
        "CASE WHEN risk_score >= 50 THEN 'MALICIOUS' ELSE 'BENIGN' END AS prediction, "
        f"{_MSG_INDICATORS} AS indicators, '' AS suspicious_tokens, {_case('severity', {k: v[0] for k, v in MESSAGE_ADVICE.items()})} AS recommendation, "
        f"{_case('severity', {k: v[1] for k, v in MESSAGE_ADVICE.items()})} AS explanation"
    )


@register("score_messages", _scored_messages(_MSG_PROB), f"SELECT {_score_messages_select()} FROM t")
def score_messages(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_messages(_clean_text(spark, sf), "cleaned_text").drop("label", "cleaned_text")


_SCORED_QR = [
    "decodes", ("given", f"SELECT ordinal, label, {sql.strip('payload')} AS raw_url FROM decodes WHERE payload IS NOT NULL"),
    *sql.canonical("given", "ordinal, label"), "url_parts", "url_features",
    ("p", f"SELECT *, {_URL_PROB} AS p FROM url_features"),
    ("r", f"SELECT *, {_RISK.format(p='p')} AS risk_score FROM p"),
    ("t", f"SELECT *, {_TIER.format(s='risk_score')} AS severity FROM r"),
]
_SCORE_QR_SELECT = (
    f"SELECT d.ordinal, coalesce(t.risk_score, 0) AS risk_score, coalesce(t.severity, 'UNKNOWN') AS severity, "
    f"coalesce({_case('t.severity', {k: v[0] for k, v in URL_POLICY.items()})}, 'ERROR') AS action, "
    "CAST(t.ordinal IS NOT NULL AS BIGINT) AS success, "
    "CASE WHEN t.ordinal IS NULL THEN 'no_qr_detected_or_unreadable' END AS error, t.normalized_url "
    "FROM decodes d LEFT JOIN t ON d.ordinal = t.ordinal"
)


@register("score_qr", _SCORED_QR, _SCORE_QR_SELECT)
def score_qr(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.score_qr(inputs.qr_decodes(spark, sf))
    return rows.select("ordinal", "risk_score", "severity", "action", "success", "error", "normalized_url")


def _norm_sql(features: dict[str, str]) -> str:
    return big(str(len(features))) + " AS width, round(sqrt(" + " + ".join(f"({n})::DOUBLE * ({n})" for n in features) + "), 6) AS norm"


def _norm(df: DataFrame) -> DataFrame:
    values = vector_to_array("features")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return df.select("ordinal", F.size(values).alias("width"), norm.alias("norm"))


@register("message_vector", [*CLEAN_CHAIN, "links", "signals"], f"SELECT ordinal, {_norm_sql(SIGNALS)} FROM signals")
def message_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Width and length of the assembled signal vectors."""
    return _norm(message_vector(with_message_signals(_clean_text(spark, sf))))


@register("url_vector", [*_CANON, "url_parts", "url_features"], f"SELECT ordinal, {_norm_sql(URL_FEATURE_SQL)} FROM url_features")
def url_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Width and length of the assembled URL vectors."""
    return _norm(url_vector(with_url_features(with_canonical_url(inputs.url_variants(spark, sf)))))


# --- terms, scaling, weights ----------------------------------------------------------------------

_WORDS = f"regexp_extract_all(lower(text), '{sql.W}{{2,}}')"
_TERM_CTES = [
    ("docs", f"SELECT doc_id, {_WORDS} AS w FROM documents"),
    ("terms", "SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM docs"),
    ("counts", "SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL"),
    ("vocab", "SELECT term, sum(tf) AS total, count(*) AS df FROM counts GROUP BY term ORDER BY total DESC, term LIMIT {size}"),
    ("weighted", "SELECT doc_id, term, {tf} * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS x "
     "FROM counts JOIN vocab USING (term)"),
    ("tfidf", "SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM weighted"),
]


def _tfidf_ctes(size: int, tf: str) -> list:
    return [(name, body.replace("{size}", str(size)).replace("{tf}", tf)) for name, body in _TERM_CTES]


@register(
    "vocabulary",
    _tfidf_ctes(10_000, "tf")[:4],
    "SELECT term, CAST(total AS BIGINT) AS total, CAST(df AS BIGINT) AS df FROM vocab",
)
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The 10,000 most frequent 1-2-grams."""
    return terms.vocabulary(terms.with_terms(inputs.table(spark, sf, "documents"), "text"))


@register("tfidf_terms", _tfidf_ctes(10_000, "tf"), "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    """L1: TF-IDF of 1-2-grams."""
    return terms.tfidf(inputs.spread(spark, sf, "documents", "doc_id"), "doc_id", "text")


@register("tfidf_sublinear", _tfidf_ctes(768, "(1 + ln(tf))"), "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_sublinear(spark: SparkSession, sf: str) -> DataFrame:
    """L2: the 768-term variant with damped counts."""
    return terms.tfidf(inputs.spread(spark, sf, "documents", "doc_id"), "doc_id", "text", size=768, sublinear=True)


@register(
    "topk_tokens",
    [
        *_tfidf_ctes(10_000, "tf"),
        ("odds", "SELECT term, ln((1 + count(*) FILTER (toxic = 1))::DOUBLE / (1 + count(*) FILTER (toxic = 0))) AS coefficient "
         "FROM tfidf JOIN labels USING (doc_id) GROUP BY term"),
        ("scores", "SELECT doc_id, term AS word, weight * coefficient AS importance FROM tfidf JOIN odds USING (term) WHERE NOT contains(term, ' ')"),
    ],
    f"SELECT doc_id, CAST(rank AS BIGINT) AS rank, word, {dbl(sql.round_even('importance', 4))} AS importance FROM ("
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, word) AS rank FROM scores WHERE importance > 0.0001::DOUBLE) WHERE rank <= 5",
)
def topk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Five strongest words per document; the coefficients are log odds from the labelled documents."""
    # Read twice, for the coefficients and for the scores.
    weights = stored(terms.tfidf(inputs.spread(spark, sf, "documents", "doc_id"), "doc_id", "text"), "weights")
    labelled = weights.join(inputs.table(spark, sf, "labels"), "doc_id")
    odds = labelled.groupBy("term").agg(
        F.log((F.count_if(F.col("toxic") == 1) + 1.0) / (F.count_if(F.col("toxic") == 0) + 1.0)).alias("coefficient")
    )
    return terms.token_attribution(weights, odds, "doc_id")


_SCALED = URL_FEATURES


@register(
    "standardize",
    [*_CANON, "url_parts", "url_features",
     ("m", "SELECT " + ", ".join(
         f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s" for c in _SCALED
     ) + " FROM url_features WHERE label = 1")],
    "SELECT ordinal, " + ", ".join(f"{dbl(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in _SCALED) + " FROM url_features, m",
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    """L3: scaling with the statistics of the label-1 rows only, applied to all rows."""
    rows = with_url_features(with_canonical_url(inputs.url_variants(spark, sf))).select("ordinal", "label", *_SCALED)
    return terms.standardize(rows, rows.filter(F.col("label") == 1), _SCALED).drop("label")


@register(
    "class_weights",
    ["sources"],
    "SELECT CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS \"rows\", round(sum(n) OVER () / (2.0::DOUBLE * n), 6) AS weight, "
    "round((1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER (), 6) AS inverse_weight FROM (SELECT label, count(*) AS n FROM sources GROUP BY label)",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.url_sources(spark, sf)
    inverse = terms.class_weights(rows, inverse=True).select("label", F.col("weight").alias("inverse_weight"))
    return terms.class_weights(rows).join(inverse, "label")


@register(
    "model_text",
    CLEAN_CHAIN,
    "SELECT ordinal, md5('[CHANNEL: ' || channel || '] ' || cleaned_text) AS digest FROM clean",
)
def model_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clean_text(spark, sf)
    return rows.select("ordinal", F.md5(channel_prefixed(F.col("cleaned_text"), F.col("channel"))).alias("digest"))
