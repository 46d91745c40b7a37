"""Reports on message and QR tables: purge counts, data quality, duplicates, decode statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CHANNELS


def purge_counts(tagged: DataFrame) -> DataFrame:
    """Rows per purge reason; ``kept`` for the rest."""
    return tagged.groupBy(F.coalesce("purge_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and percentage per value."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("rows") * 100.0 / total, 6))


def quality_audit(clean: DataFrame) -> DataFrame:
    """Completeness, uniqueness, validity and channel validity in percent, and their mean; one row.

    The rows are first reduced to one per distinct text, so counting distinct texts needs no second pass.
    """
    text = F.col("cleaned_text")
    per_text = clean.groupBy(F.sha2(text, 256).alias("__digest")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(text.isNull()).alias("missing"),
        F.count_if(F.col("message_length") >= 3).alias("valid"),
        F.count_if(F.col("channel").isin(CHANNELS)).alias("channel_ok"),
    )
    total = F.sum("n")

    def percent(part: Column) -> Column:
        return F.coalesce(part * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0))

    scores = per_text.agg(
        F.coalesce(total, F.lit(0)).alias("rows"),
        percent(total - F.sum("missing")).alias("completeness"),
        percent(F.count(F.lit(1))).alias("uniqueness"),
        percent(F.sum("valid")).alias("validity"),
        percent(F.sum("channel_ok")).alias("channel_validity"),
    )
    parts = ["completeness", "uniqueness", "validity", "channel_validity"]
    return scores.withColumn("overall", sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / 4.0)


def duplicate_report(urls: DataFrame, samples: int = 5, ordinal: str = "ordinal") -> DataFrame:
    """URLs seen more than once: label counts, cross-label conflict and the first file names, in no order.

    Reads a stored table twice: for the counts, and for the sample. Counting is a partial aggregate and the sample a small
    per-URL limit that every map task applies before the shuffle, so a URL that fills a third of the table stays cheap.
    Both sides hash on the URL: the join adds no shuffle.
    """
    rows = urls.select("normalized_url", "label", ordinal, "image_filename")
    counts = rows.groupBy("normalized_url").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.count_if(F.col("label") == 0).alias("benign_count"),
        F.count_if(F.col("label") == 1).alias("malicious_count"),
    )
    counts = counts.filter(F.col("occurrence_count") > 1)
    rank = F.row_number().over(Window.partitionBy("normalized_url").orderBy(ordinal))
    first = rows.select("normalized_url", ordinal, "image_filename").withColumn("__rank", rank)
    first = first.filter(F.col("__rank") <= samples)
    names = first.groupBy("normalized_url").agg(
        F.array_sort(F.collect_list(F.struct("__rank", "image_filename"))).alias("__first")
    )
    conflict = ((F.col("benign_count") > 0) & (F.col("malicious_count") > 0)).cast("int")
    return counts.join(names, "normalized_url").select(
        "normalized_url", "occurrence_count", "benign_count", "malicious_count",
        conflict.alias("is_cross_label_conflict"),
        F.array_join(F.col("__first.image_filename"), ";").alias("sample_image_filenames"),
    )


FLAGS = {
    "has_http": "http_count",
    "has_https": "https_count",
    "has_ip_address": "ip_count",
    "has_shortener_pattern": "shortener_count",
    "has_port": "port_count",
    "has_at_symbol": "at_count",
    "has_encoded_characters": "encoded_count",
}


def _counted(raw: DataFrame) -> DataFrame:
    """One row for each domain and URL, and one for all other rows: the additive counts of a QR decode table."""
    ok = F.col("decode_status") == "success"
    url = ok & (F.col("content_type") == "url")
    additive = {
        "total_images": F.lit(True),
        "malicious_images": F.col("label") == 1,
        "benign_images": F.col("label") == 0,
        "successful_decodes": ok,
        "failed_decodes": ~ok,
        "successful_malicious": ok & (F.col("label") == 1),
        "successful_benign": ok & (F.col("label") == 0),
        "decoded_urls": url,
        "decoded_non_urls": ok & (F.col("content_type") != "url"),
        **{name: url & (F.col(flag) == 1) for flag, name in FLAGS.items()},
    }
    domain, address = F.when(url, F.col("domain")), F.when(url, F.col("normalized_url"))
    return raw.groupBy(domain.alias("__domain"), address.alias("__url")).agg(*[F.count_if(c).alias(n) for n, c in additive.items()])


ADDITIVE = [
    "total_images", "malicious_images", "benign_images", "successful_decodes", "failed_decodes", "successful_malicious",
    "successful_benign", "decoded_urls", "decoded_non_urls", *FLAGS.values(),
]


def decode_statistics(raw: DataFrame) -> DataFrame:
    """Totals, rates, distinct URLs and domains, flag counts of a QR decode table; one row.

    Rows shrink in three steps, to one per URL, per domain and in all. Every count is a sum along that chain, so the
    two distinct counts fall out of it and no row is expanded per distinct count.
    """
    return statistics_of(_counted(raw))


def statistics_of(per_url: DataFrame) -> DataFrame:
    """The statistics from one row for each domain and URL."""
    per_domain = per_url.groupBy("__domain").agg(
        *[F.sum(name).alias(name) for name in ADDITIVE],
        F.count("__url").alias("unique_urls"),
        F.count_if(F.col("decoded_urls") > 1).alias("duplicate_urls"),
    )
    summed = [*ADDITIVE, "unique_urls", "duplicate_urls"]
    out = per_domain.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in summed],
        F.count_if(F.col("__domain") != "").alias("unique_domains"),
    )

    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) * 100.0 / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    return out.withColumns(
        {
            "overall_decode_rate": rate("successful_decodes", "total_images"),
            "malicious_decode_rate": rate("successful_malicious", "malicious_images"),
            "benign_decode_rate": rate("successful_benign", "benign_images"),
        }
    )


def decode_partials(raw: DataFrame, ordinal: str, samples: int = 5) -> DataFrame:
    """What the reports need of one batch: counts per domain and URL, and the first files of each URL.

    Partials of any batches merge to those of all their rows (``merge_partials``). Reads a stored table twice.
    """
    urls = raw.filter((F.col("decode_status") == "success") & (F.col("content_type") == "url"))
    place = F.struct(F.col(ordinal).alias("place"), "image_filename")
    rank = F.row_number().over(Window.partitionBy("normalized_url").orderBy(ordinal))
    first = urls.select("normalized_url", ordinal, place.alias("file")).withColumn("__rank", rank).filter(F.col("__rank") <= samples)
    first = first.groupBy("normalized_url").agg(F.array_sort(F.collect_list("file")).alias("first"))
    return _counted(raw).join(first, F.col("__url") == F.col("normalized_url"), "left").drop("normalized_url")


def merge_partials(partials: DataFrame, samples: int = 5) -> DataFrame:
    """The partials of many batches as those of one. A URL gathers at most ``samples`` files of each batch."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, samples)
    return partials.groupBy("__domain", "__url").agg(*[F.sum(name).alias(name) for name in ADDITIVE], first.alias("first"))


def duplicates_of(merged: DataFrame) -> DataFrame:
    """The duplicate report from merged partials; a URL has one domain."""
    rows = merged.filter(F.col("__url").isNotNull() & (F.col("decoded_urls") > 1))
    conflict = ((F.col("benign_images") > 0) & (F.col("malicious_images") > 0)).cast("int")
    return rows.select(
        F.col("__url").alias("normalized_url"), F.col("decoded_urls").alias("occurrence_count"), F.col("benign_images").alias("benign_count"),
        F.col("malicious_images").alias("malicious_count"), conflict.alias("is_cross_label_conflict"),
        F.array_join(F.col("first.image_filename"), ";").alias("sample_image_filenames"),
    )
