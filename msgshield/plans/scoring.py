"""Scoring of whole tables: URLs, messages, QR payloads. All steps are row-wise, so they also run on streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import explain, risk
from ..functions.chars import round_exact, strip
from ..functions.fixed import MESSAGE_FEATURES, URL_FEATURES
from ..functions.signals import with_message_signals
from ..functions.text import channel_prefixed
from ..functions.urls import root_domain, with_canonical_url, with_url_features

URL_RESULT = [
    "original_url", "normalized_url", "domain", "root_domain", "source", "raw_p_malicious", "calibrated_p_malicious",
    "risk_score", "severity", "action", "guidance", "indicators", "suspicious_tokens", "explanation",
]
MESSAGE_RESULT = [
    "channel", "raw_probability", "calibrated_probability", "risk_score", "severity", "action", "prediction",
    "indicators", "suspicious_tokens", "recommendation", "explanation",
]


def _with_probability(df: DataFrame, model: PipelineModel | None, heuristic) -> DataFrame:
    """Add ``__raw`` and ``__cal``. A model bundle ends with its calibrator (column ``calibrated``), if it has one."""
    if model is None:
        df = df.withColumn("__raw", heuristic)
        return df.withColumn("__cal", risk.clip(F.col("__raw")))
    out = model.transform(df).withColumn("__raw", vector_to_array("probability")[1])
    calibrated = F.col("calibrated") if "calibrated" in out.columns else F.col("__raw")
    return out.withColumn("__cal", risk.clip(calibrated)).select(*df.columns, "__raw", "__cal")


def score_urls(df: DataFrame, url: str = "raw_url", source: str = "direct_url", model: PipelineModel | None = None) -> DataFrame:
    """Add the 14 result columns to a table of URLs; without a model the feature heuristic gives the probability."""
    keep = [c for c in df.columns if c not in URL_RESULT]
    rows = with_url_features(with_canonical_url(df, url))
    rows = _with_probability(rows, model, risk.url_heuristic_score())
    rows = rows.withColumns({"root_domain": root_domain(F.col("domain")), "risk_score": risk.risk_score(F.col("__cal"))})
    rows = rows.withColumn("severity", risk.severity(F.col("risk_score")))
    rows = rows.withColumn("indicators", explain.url_indicators(F.col("severity")))
    rows = rows.withColumns(
        {
            "source": F.lit(source),
            "raw_p_malicious": round_exact(F.col("__raw"), 4),
            "calibrated_p_malicious": round_exact(F.col("__cal"), 4),
            **risk.url_policy(F.col("severity")),
            "suspicious_tokens": explain.suspicious_tokens(),
            "explanation": explain.url_summary(F.col("risk_score"), F.col("severity"), F.col("indicators")),
        }
    )
    return rows.select(*keep, *URL_RESULT)


def score_messages(
    df: DataFrame, text: str = "text", model: PipelineModel | None = None, mode: str = "compat"
) -> DataFrame:
    """Add the 11 result columns to a table of messages; ``channel`` is SMS unless the table has one.

    A model reads ``model_text``, the text with its channel tag, as in training.
    """
    channel = F.coalesce("channel", F.lit("SMS")) if "channel" in df.columns else F.lit("SMS")
    keep = [c for c in df.columns if c not in MESSAGE_RESULT and c not in MESSAGE_FEATURES]
    rows = with_message_signals(df.withColumn("channel", channel), text)
    if model is not None:
        rows = rows.withColumn("model_text", channel_prefixed(F.coalesce(text, F.lit("")), F.col("channel")))
    rows = _with_probability(rows, model, risk.message_heuristic_score(mode))
    rows = rows.withColumn("risk_score", risk.risk_score(F.col("__cal")))
    rows = rows.withColumn("severity", risk.severity(F.col("risk_score")))
    rows = rows.withColumns(
        {
            "raw_probability": round_exact(F.col("__raw"), 4),
            "calibrated_probability": round_exact(F.col("__cal"), 4),
            "action": risk.message_policy(F.col("severity"))["action"],
            "prediction": risk.message_verdict(F.col("risk_score")),
            "indicators": explain.message_indicators(F.col("severity")),
            # Token attributions are a table of their own (token_attribution); the online result has none.
            "suspicious_tokens": F.array().cast("array<string>"),
            **risk.message_advice(F.col("severity")),
        }
    )
    return rows.select(*keep, *MESSAGE_RESULT)


def score_qr(decodes: DataFrame, payload: str = "payload", model: PipelineModel | None = None) -> DataFrame:
    """Score decoded payloads as URLs. A failed decode keeps risk 0, severity UNKNOWN and action ERROR."""
    rows = decodes.withColumn("decoded_text", strip(F.col(payload)))
    rows = rows.withColumn("success", F.coalesce(F.col("decoded_text") != "", F.lit(False)))
    scored = score_urls(rows, "decoded_text", "qr_decoded", model)
    failure = {"risk_score": F.lit(0), "severity": F.lit("UNKNOWN"), "action": F.lit("ERROR")}
    ok = F.col("success")
    scored = scored.withColumns({c: F.when(ok, F.col(c)).otherwise(failure.get(c)) for c in URL_RESULT})
    message = F.lit("No QR code pattern detected in the image.")
    if "decode_error" in decodes.columns:
        message = F.coalesce(F.nullif(F.col("decode_error"), F.lit("")), message)
    return scored.withColumns(
        {"error": F.when(~ok, message), "decoded_text": F.when(ok, F.col("decoded_text"))}
    )


__all__ = ["score_urls", "score_messages", "score_qr", "URL_RESULT", "MESSAGE_RESULT", "URL_FEATURES"]
