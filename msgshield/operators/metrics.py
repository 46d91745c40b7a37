"""Classification metrics from scored rows: every figure follows from additive counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import round_exact
from ..functions.fixed import ACCURACY_TOLERANCE, CHANNELS, MESSAGE_TARGETS, URL_F1_TARGET, URL_SUITES
from .ordering import prefix_sums

COUNTS = ["TP", "FP", "TN", "FN"]


def confusion_counts(label: str = "label", pred: str = "pred") -> list[Column]:
    """Aggregates TP, FP, TN, FN; label 1 is positive."""
    y, p = F.col(label), F.col(pred)
    cells = {"TP": (1, 1), "FP": (0, 1), "TN": (0, 0), "FN": (1, 0)}
    return [F.count_if((y == a) & (p == b)).alias(name) for name, (a, b) in cells.items()]


def confusion(df: DataFrame, *groups: str, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(*groups).agg(*confusion_counts(label, pred))


def _share(part: Column, whole: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def with_scores(df: DataFrame) -> DataFrame:
    """Add accuracy, binary and macro precision, recall and F1 to a frame with the four counts."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    df = df.withColumns(
        {
            "samples": tp + fp + tn + fn,
            "accuracy": _share(tp + tn, tp + fp + tn + fn),
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(tp * 2, tp * 2 + fp + fn),
            "__p0": _share(tn, tn + fn),
            "__r0": _share(tn, tn + fp),
            "__f0": _share(tn * 2, tn * 2 + fp + fn),
        }
    )
    return df.withColumns(
        {
            "macro_precision": (F.col("precision") + F.col("__p0")) / 2.0,
            "macro_recall": (F.col("recall") + F.col("__r0")) / 2.0,
            "macro_f1": (F.col("f1") + F.col("__f0")) / 2.0,
        }
    ).drop("__p0", "__r0", "__f0")


def as_percent(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    df = df.withColumns({c: F.col(c) * 100.0 for c in columns})
    return df.withColumns({c: round_exact(F.col(c), digits) for c in columns})


def message_matrix(scored: DataFrame) -> DataFrame:
    """Seven evaluation levels from rows with label, pred, channel and split (test_a, test_b, test_c).

    One pass: counts per (split, channel) are the only thing shuffled; each level is a sum of them. The external set
    C has its own level and takes no part in the overall and channel levels.
    """
    cells = confusion(scored.filter(F.col("split").isin("test_a", "test_b", "test_c")), "split", "channel")
    levels = F.array_compact(
        F.array(
            F.when(F.col("split") != "test_c", "Overall Master Test Set"),
            F.when(
                (F.col("split") != "test_c") & F.col("channel").isin(CHANNELS),
                F.concat(F.lit("Channel: "), F.col("channel")),
            ),
            F.when(F.col("split") == "test_a", "Test A (Standard Stratified)"),
            F.when(F.col("split") == "test_b", "Test B (Unseen Templates)"),
            F.when(F.col("split") == "test_c", "Test C (External Unseen Dataset)"),
        )
    )
    cells = cells.withColumn("level", F.explode(levels))
    return with_targets(cells.groupBy("level").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def with_targets(counts: DataFrame) -> DataFrame:
    """Metrics, target and status of message levels; PASS allows 2.5 points below the target."""
    target = None
    for level, value in MESSAGE_TARGETS.items():
        target = F.when(F.col("level") == level, value) if target is None else target.when(F.col("level") == level, value)
    out = with_scores(counts).withColumn("target", target)
    passed = F.col("target").isNull() | (F.col("accuracy") * 100.0 >= F.col("target") - ACCURACY_TOLERANCE)
    out = out.withColumn("status", F.when(passed, "PASS").otherwise("EVAL"))
    out = as_percent(out, ["accuracy", "macro_f1", "macro_precision", "macro_recall"])
    return out.select(
        "level", "samples", "accuracy", "macro_f1", "macro_precision", "macro_recall",
        F.when(F.col("target").isNull(), "--").otherwise(F.format_string(">= %.1f%%", "target")).alias("target"),
        "status", *COUNTS,
    )


def roc_auc(scored: DataFrame, *groups: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; 0 if a class is missing.

    Rows are first reduced to positives and negatives per distinct score. Each score then needs the negatives below
    it, a prefix sum that runs in parallel over quantile buckets.
    """
    y = F.col(label)
    scores = scored.groupBy(*groups, F.col(prob).alias("__score")).agg(
        F.count_if(y == 1).alias("__pos"), F.count_if(y == 0).alias("__neg")
    )
    below = prefix_sums(scores, list(groups), "__score", ["__neg"])
    wins = F.col("__pos") * (F.col("__neg_before") * 2 + F.col("__neg"))
    # Twice the number of ordered pairs won stays an integer; decimals keep it exact beyond 2**63.
    agg = below.groupBy(*groups).agg(
        F.sum(wins.cast("decimal(38,0)")).alias("__wins"), F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n")
    )
    auc = F.when(
        (F.col("__p") > 0) & (F.col("__n") > 0),
        F.col("__wins").cast("double") / (F.col("__p").cast("double") * F.col("__n").cast("double") * 2.0),
    ).otherwise(0.0)
    return agg.select(*groups, auc.alias("roc_auc"))


def confidence_bin(prob: Column, bins: int = 10) -> Column:
    """Index of the equal-width bin [lo, hi); the last one is closed. The edges are the doubles i * 0.1."""
    index = F.when(prob.between(0.0, 1.0), 0)
    for i in range(1, bins):
        edge = i * (1.0 / bins)
        index = F.when((prob >= edge) & (prob <= 1.0), i).otherwise(index)
    return index


def calibration_error(
    scored: DataFrame, *groups: str, label: str = "label", prob: str = "prob", bins: int = 10
) -> DataFrame:
    """Expected calibration error and Brier score."""
    y, p = F.col(label).cast("double"), F.col(prob)
    binned = scored.groupBy(*groups, confidence_bin(p, bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg(y).alias("__acc"),
        F.avg(p).alias("__conf"),
        F.sum((p - y) * (p - y)).alias("__sq"),
    )
    gap = F.when(F.col("__bin").isNotNull(), F.col("__n") * F.abs(F.col("__acc") - F.col("__conf"))).otherwise(0.0)
    return binned.groupBy(*groups).agg(
        (F.sum(gap) / F.sum("__n")).alias("ece"), (F.sum("__sq") / F.sum("__n")).alias("brier")
    )


def url_suite_matrix(scored: DataFrame) -> DataFrame:
    """Metrics per URL test suite from rows with suite, label, prob (calibrated); the class is prob >= 0.5."""
    rows = scored.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    out = with_scores(confusion(rows, "suite"))
    out = out.join(roc_auc(rows, "suite"), "suite").join(calibration_error(rows, "suite"), "suite")
    out = as_percent(out, ["accuracy", "precision", "recall", "f1", "ece"])
    # A suite with one class only has no 2 x 2 matrix: all four counts are reported as 0.
    square = ((F.col("TP") + F.col("FN") > 0) | (F.col("TP") + F.col("FP") > 0)) & (
        (F.col("TN") + F.col("FP") > 0) | (F.col("TN") + F.col("FN") > 0)
    )
    title = F.col("suite")
    for name, text in URL_SUITES.items():
        title = F.when(F.col("suite") == name, text).otherwise(title)
    return out.select(
        "suite", title.alias("title"), "samples", "accuracy", "precision", "recall", "f1",
        round_exact(F.col("roc_auc"), 4).alias("roc_auc"), "ece",
        F.when(F.col("f1") >= URL_F1_TARGET, "PASS").otherwise("INVESTIGATE").alias("status"),
        *[F.when(square, F.col(c)).otherwise(0).alias(c) for c in COUNTS],
    )


def stage_comparison(scored: DataFrame) -> DataFrame:
    """Accuracy and macro F1 on test A and B, one row per model stage (columns stage, split, label, pred)."""
    metrics = as_percent(with_scores(confusion(scored, "stage", "split")), ["accuracy", "macro_f1"])
    wide = metrics.groupBy("stage").pivot("split", ["test_a", "test_b"])
    return wide.agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))
