"""QR payload expressions: artifact removal, URL extraction and the 16 URL features.

The payload normalisation differs from the canonical form in ``urls``: it only lower-cases scheme and authority, and
drops the ``;parameters`` of the last path segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import ALNUM, SPACE, count_digits, count_not_class, strip
from .fixed import QR_FEATURES, QR_SHORTENERS
from .urls import IPV4, IPV6, malformed_netloc, with_url_parts

LISTED_URL = rf"(?imud)^[{SPACE}]*\p{{Nd}}+[{SPACE}]+(https?://[^{SPACE}]+)"
ANY_URL = rf"(?iu)https?://[^{SPACE}]+"


def strip_series_artifact(col: Column) -> Column:
    """Undo the printed form of a one-element column: the ``Name: ...`` tail and the leading row number."""
    text = strip(F.coalesce(col, F.lit("")))
    text = strip(F.regexp_replace(text, F.lit(r"(?s)\nName:.*"), F.lit("")))
    return strip(F.regexp_replace(text, F.lit(rf"\A\p{{Nd}}+[{SPACE}]+"), F.lit("")))


def _with_parts(df: DataFrame, payload: str) -> DataFrame:
    """Payload to ``normalized_url``, ``content``, ``content_type``, and the parts of the URL as helper columns."""
    c = lambda name: F.col("__" + name)
    out = df.withColumn("__text", F.coalesce(F.col(payload), F.lit("")))
    out = out.withColumns({"content": strip_series_artifact(c("text")), "__hasurl": F.contains(c("text"), F.lit("://"))})
    out = out.withColumn("__listed", F.when(c("hasurl"), F.regexp_extract(c("text"), LISTED_URL, 1)).otherwise(""))
    out = out.withColumn(
        "__found",
        F.when(~c("hasurl"), "")
        .when(c("listed") != "", c("listed"))
        .when(F.lower("content").rlike(r"\Ahttps?://"), F.regexp_extract("content", rf"\A[^{SPACE}]+", 0))
        .otherwise(F.regexp_extract(c("text"), ANY_URL, 0)),
    )
    out = with_url_parts(out, "__found")
    out = out.withColumn(
        "__isurl", c("scheme").isin("http", "https") & (c("netloc") != "") & ~malformed_netloc(c("netloc"))
    )
    out = _with_bare_path(out)
    out = out.withColumns(
        {
            "normalized_url": F.when(
                c("isurl"),
                F.concat(
                    c("scheme"),
                    F.lit("://"),
                    c("netloc"),
                    c("barepath"),
                    F.when(c("query") != "", F.concat(F.lit("?"), c("query"))).otherwise(""),
                    F.when(c("fragment") != "", F.concat(F.lit("#"), c("fragment"))).otherwise(""),
                ),
            ),
            "content_type": F.when(c("text") == "", "unknown").when(c("isurl"), "url").otherwise("non_url"),
        }
    )
    return out.drop("__text", "__hasurl", "__listed", "__found")


def _with_bare_path(df: DataFrame) -> DataFrame:
    """Lower-case the authority; cut the parameters: from the first ';' of the last path segment on."""
    path = F.col("__path")
    segment = F.substring_index(path, "/", -1)
    kept = F.length(path) - F.length(segment) + F.length(F.substring_index(segment, ";", 1))
    return df.withColumns({"__netloc": F.lower("__netloc"), "__barepath": F.substr(path, F.lit(1), kept)})


EXTRACTED = ["normalized_url", "content", "content_type"]


def with_extracted_url(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``normalized_url`` (null if there is none), ``content`` and ``content_type``."""
    out = _with_parts(df, payload)
    return out.select(*[x for x in df.columns if x not in EXTRACTED], *EXTRACTED)


def with_extracted_features(df: DataFrame, payload: str = "payload") -> DataFrame:
    """URL extraction and the 16 features in one go: the parts found first are not parsed again."""
    out = _with_parts(df, payload).withColumn("__value", F.coalesce("normalized_url", F.lit("")))
    out = _with_features(out.withColumnRenamed("__isurl", "__valid"))
    added = EXTRACTED + QR_FEATURES
    return out.select(*[x for x in df.columns if x not in added], *added)


def with_qr_features(df: DataFrame, url: str = "normalized_url") -> DataFrame:
    """Add the 16 features of a normalised QR URL; 0 and '' where there is no URL."""
    out = with_url_parts(df.withColumn("__value", F.coalesce(F.col(url), F.lit(""))), "__value")
    valid = (F.col("__value") != "") & ~malformed_netloc(F.col("__netloc"))
    out = _with_features(_with_bare_path(out.withColumn("__valid", valid)))
    return out.select(*[x for x in df.columns if x not in QR_FEATURES], *QR_FEATURES)


def _with_features(out: DataFrame) -> DataFrame:
    """The features, from the helper columns value, valid, scheme, netloc, barepath, query, fragment.

    A port that is no number in 0..65535 stops the extraction: everything read after it stays 0.
    """
    c = lambda name: F.col("__" + name)
    out = out.withColumn("__hostport", F.substring_index(c("netloc"), "@", -1))
    bracketed = F.startswith(c("hostport"), F.lit("["))
    out = out.withColumn(
        "__rawhost",
        F.when(bracketed, F.substring_index(F.substr(c("hostport"), F.lit(2)), "]", 1)).otherwise(
            F.substring_index(c("hostport"), ":", 1)
        ),
    )
    out = out.withColumns(
        {
            "__port": F.when(bracketed, F.regexp_extract(c("hostport"), r"\]:(.*)", 1)).otherwise(
                F.substr(c("hostport"), F.length(c("rawhost")) + 2)
            ),
            "__host": F.when(c("valid"), c("rawhost")).otherwise(""),
        }
    )
    number = F.expr("try_cast(__port AS bigint)")
    out = out.withColumn(
        "__portok", (c("port") == "") | (c("port").rlike(r"\A[0-9]+\z") & (F.coalesce(number, F.lit(70000)) <= 65535))
    )
    after_port = c("valid") & c("portok")
    labels = F.length(c("host")) - F.length(F.replace(c("host"), F.lit("."), F.lit(""))) + 1

    def when(condition: Column, value: Column) -> Column:
        return F.when(condition, value.cast("int")).otherwise(0)

    features = {
        "url_length": F.length(c("value")),
        "domain": c("host"),
        "domain_length": F.length(c("host")),
        "path_length": when(c("valid"), F.length(c("barepath"))),
        "query_length": when(c("valid"), F.length(c("query"))),
        "fragment_length": when(c("valid"), F.length(c("fragment"))),
        "subdomain_count": when(after_port & (c("host") != ""), F.greatest(labels - 2, F.lit(0))),
        "has_https": when(c("valid"), c("scheme") == "https"),
        "has_http": when(c("valid"), c("scheme") == "http"),
        "has_ip_address": when(after_port, c("host").rlike(rf"\A(?:{IPV4}|{IPV6})\z")),
        "has_port": when(after_port & (c("port") != ""), number > 0),
        "has_at_symbol": F.contains(c("value"), F.lit("@")).cast("int"),
        "has_encoded_characters": F.contains(c("value"), F.lit("%")).cast("int"),
        "has_shortener_pattern": when(after_port, c("host").isin(QR_SHORTENERS)),
        "digit_count": count_digits(c("value")),
        "special_character_count": count_not_class(c("value"), ALNUM),
    }
    return out.withColumns(features)
