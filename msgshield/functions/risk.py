"""Risk expressions: heuristic probabilities, 0..100 score, tiers, actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import MESSAGE_ADVICE, MESSAGE_POLICY, URL_POLICY


def _score(parts: list[tuple[Column, float]]) -> Column:
    """0.05 plus the weight of every condition that holds, at most 0.99."""
    total = F.lit(0.05)
    for condition, weight in parts:
        total = total + F.when(condition, weight).otherwise(0.0)
    return F.least(F.lit(0.99), total)


def message_heuristic_score(mode: str = "compat") -> Column:
    """Probability of a message from its signals.

    ``compat`` keeps the known behaviour: the urgency, threat and credential weights are bound to signal names that
    no extractor emits, so only the shortened link counts. ``intended`` reads the real signals.
    """
    short = (F.col("has_shortened_url") == 1.0, 0.25)
    if mode == "compat":
        return _score([short])
    if mode != "intended":
        raise ValueError(f"mode must be 'compat' or 'intended', not {mode!r}")
    return _score(
        [
            (F.col("urgency_score") > 0, 0.35),
            (F.col("account_threat") == 1.0, 0.30),
            (F.col("credential_request") == 1.0, 0.30),
            short,
        ]
    )


def url_heuristic_score() -> Column:
    """Probability of a URL from its features."""
    weights = {
        "has_ip_host": 0.45,
        "has_suspicious_tld": 0.25,
        "has_shortener": 0.20,
        "has_login_kw": 0.20,
        "has_brand_kw": 0.30,
    }
    return _score([(F.col(name) == 1.0, weight) for name, weight in weights.items()])


def clip(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def risk_score(probability: Column) -> Column:
    """Nearest integer of 100 p, ties to even, within 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(probability * 100.0).cast("int")))


def severity(score: Column, low: int = 25, medium: int = 50, high: int = 80) -> Column:
    """Tier of a score; each threshold is the first score of the next tier."""
    return F.when(score < low, "LOW").when(score < medium, "MEDIUM").when(score < high, "HIGH").otherwise("CRITICAL")


def _by_tier(tier: Column, values: dict[str, str]) -> Column:
    chain = F.when(tier == "LOW", values["LOW"])
    for name in ("MEDIUM", "HIGH"):
        chain = chain.when(tier == name, values[name])
    return chain.otherwise(values["CRITICAL"])


def message_policy(tier: Column) -> dict[str, Column]:
    """Action, status and colour of a message tier."""
    return {
        name: _by_tier(tier, {k: v[i] for k, v in MESSAGE_POLICY.items()})
        for i, name in ((1, "action"), (2, "status"), (3, "color"))
    }


def message_advice(tier: Column) -> dict[str, Column]:
    return {
        name: _by_tier(tier, {k: v[i] for k, v in MESSAGE_ADVICE.items()})
        for i, name in ((0, "recommendation"), (1, "explanation"))
    }


def url_policy(tier: Column) -> dict[str, Column]:
    return {
        name: _by_tier(tier, {k: v[i] for k, v in URL_POLICY.items()}) for i, name in ((0, "action"), (1, "guidance"))
    }


def message_verdict(score: Column) -> Column:
    return F.when(score >= 50, "MALICIOUS").otherwise("BENIGN")
