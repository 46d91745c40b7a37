"""Explanation expressions: rule indicators, highlighted tokens and summary sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import round_exact
from .fixed import MESSAGE_CLEAN_SENTENCE, MESSAGE_LINK_SENTENCES, MESSAGE_SIGNAL_SENTENCES
from .fixed import MESSAGE_STATISTICAL_SENTENCE, MESSAGE_UPPERCASE_SENTENCE, URL_INDICATORS, URL_KEYWORDS, URL_SUMMARY


def message_indicators(tier: Column) -> Column:
    """Sentences of the signals that fired; one link sentence at most; a fallback if none fired."""
    sentences = [F.when(F.col(name) > 0, text) for name, text in MESSAGE_SIGNAL_SENTENCES.items()]
    link = None
    for name, text in MESSAGE_LINK_SENTENCES.items():
        link = F.when(F.col(name) > 0, text) if link is None else link.when(F.col(name) > 0, text)
    sentences += [link, F.when(F.col("uppercase_ratio") > 0.25, MESSAGE_UPPERCASE_SENTENCE)]
    fallback = F.when(tier == "LOW", MESSAGE_CLEAN_SENTENCE).otherwise(MESSAGE_STATISTICAL_SENTENCE)
    fired = F.array_compact(F.array(*sentences))
    nothing = F.coalesce(*sentences).isNull()
    return F.when(nothing, F.array(fallback)).otherwise(fired)


def _indicator(name: str, *values: Column) -> Column:
    level, title, description = URL_INDICATORS[name]

    def text(template: str) -> Column:
        return F.format_string(template, *values) if "%" in template else F.lit(template)

    return F.struct(
        F.lit(level).alias("level"), text(title).alias("title"), text(description).alias("description")
    )


def url_indicators(tier: Column) -> Column:
    """Records (level, title, description) of the rules that fired; one INFO record for a clean LOW URL."""
    domain = F.col("domain")
    tld = F.substring_index(domain, ".", -1)
    # Two decimals of an entropy in 0..log2(length); ties cannot be told apart from the stored double otherwise.
    entropy = round_exact(F.col("url_entropy"), 2)
    rules = [
        (F.col("has_ip_host") == 1.0, _indicator("has_ip_host", domain)),
        (F.col("has_shortener") == 1.0, _indicator("has_shortener")),
        (F.col("has_suspicious_tld") == 1.0, _indicator("has_suspicious_tld", tld)),
        (F.col("has_punycode") == 1.0, _indicator("has_punycode")),
        (F.col("subdomain_count") >= 3, _indicator("subdomain_count", F.col("subdomain_count").cast("int"))),
        (F.col("url_entropy") > 4.5, _indicator("url_entropy", entropy)),
        (F.col("is_https") == 0.0, _indicator("is_https")),
        (F.col("consecutive_hyphens") == 1.0, _indicator("consecutive_hyphens")),
        (F.col("has_login_kw") == 1.0, _indicator("has_login_kw")),
        (F.col("has_brand_kw") == 1.0, _indicator("has_brand_kw")),
    ]
    any_fired = reduce(lambda x, y: x | y, [condition for condition, _ in rules])
    clean = F.when(~any_fired & (tier == "LOW"), _indicator("clean"))
    return F.array_compact(F.array(*[F.when(condition, record) for condition, record in rules], clean))


def suspicious_tokens(limit: int = 8) -> Column:
    """Up to eight distinct highlights: the IP host, the odd top-level domain, the keywords found, in this order."""
    low, domain = F.lower("normalized_url"), F.col("domain")
    marks = [
        F.when(F.col("has_ip_host") == 1.0, domain),
        F.when(F.col("has_suspicious_tld") == 1.0, F.concat(F.lit("."), F.substring_index(domain, ".", -1))),
        *[F.when(F.contains(low, F.lit(k)), k) for k in URL_KEYWORDS],
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*marks))), 1, limit)


def url_summary(score: Column, tier: Column, indicators: Column) -> Column:
    return (
        F.when(
            tier.isin("HIGH", "CRITICAL"), F.format_string(URL_SUMMARY["HIGH"], tier, score, F.size(indicators))
        )
        .when(tier == "MEDIUM", F.format_string(URL_SUMMARY["MEDIUM"], score))
        .otherwise(F.format_string(URL_SUMMARY["LOW"], score))
    )
