import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from msgshield.functions import risk
from msgshield.operators import metrics
from msgshield.operators.reports import markdown_rows
from msgshield.plans.training import fit_calibrator

# Published confusion counts with the figures that follow from them.
MESSAGE_ROWS = [
    ("Overall Master Test Set", 2512, 65, 2431, 71, 97.32, 97.32, 97.32, 97.32, "PASS"),
    ("Channel: EMAIL", 901, 29, 1299, 27, 97.52, 97.44, 97.42, 97.45, "PASS"),
    ("Channel: SMS", 1433, 32, 588, 29, 97.07, 96.49, 96.56, 96.43, "PASS"),
    ("Channel: SOCIAL_CHAT", 178, 4, 544, 15, 97.44, 96.61, 97.56, 95.75, "PASS"),
    ("Test A (Standard Stratified)", 1263, 29, 1208, 38, 97.36, 97.36, 97.35, 97.37, "PASS"),
    ("Test B (Unseen Templates)", 1249, 36, 1223, 33, 97.28, 97.28, 97.29, 97.28, "PASS"),
    ("Test C (External Unseen Dataset)", 3646, 100, 2327, 236, 94.67, 94.43, 94.06, 94.9, "PASS"),
]
URL_ROWS = [
    (2489, 244, 2855, 89, 94.13, 91.07, 96.55, 93.73),
    (3036, 329, 2726, 293, 90.26, 90.22, 91.20, 90.71),
    (1385, 247, 2332, 108, 91.28, 84.87, 92.77, 88.64),
    (239, 8, 242, 11, 96.20, 96.76, 95.60, 96.18),
]


def test_published_message_rows(spark):
    df = spark.createDataFrame([r[:5] for r in MESSAGE_ROWS], "level string, TP long, FP long, TN long, FN long")
    rows = {r.level: r for r in metrics.with_targets(df).collect()}
    for level, tp, fp, tn, fn, acc, f1, prec, rec, status in MESSAGE_ROWS:
        r = rows[level]
        assert (r.accuracy, r.macro_f1, r.macro_precision, r.macro_recall, r.status) == (acc, f1, prec, rec, status)
        assert r.samples == tp + fp + tn + fn
    assert rows["Channel: SMS"].target == ">= 95.5%"


def test_published_url_rows(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(URL_ROWS)], "i int, TP long, FP long, TN long, FN long")
    out = metrics.as_percent(metrics.with_scores(df), ["accuracy", "precision", "recall", "f1"]).orderBy("i").collect()
    assert [(r.accuracy, r.precision, r.recall, r.f1) for r in out] == [r[4:] for r in URL_ROWS]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 5, 0), (0, 0, 0, 0)], "TP long, FP long, TN long, FN long")
    a, b = metrics.with_scores(df).collect()
    assert (a.precision, a.recall, a.f1, a.macro_f1, a.accuracy) == (0.0, 0.0, 0.0, 0.5, 1.0)
    assert b.accuracy == 0.0


def scored(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        p = round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 2)
        rows.append((y, p, "big" if i % 3 else "small"))
    return spark.createDataFrame(rows, "label int, prob double, g string"), rows


def test_auc_and_calibration_against_brute_force(spark):
    df, rows = scored(spark)
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, "g").collect()}
    err = {r.g: r for r in metrics.calibration_error(df, "g").collect()}
    for g in ("big", "small"):
        part = [(y, p) for y, p, h in rows if h == g]
        pos, neg = [p for y, p in part if y], [p for y, p in part if not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert abs(auc[g] - wins / (len(pos) * len(neg))) < 1e-12
        ece = 0.0
        for i in range(10):
            lo, hi = i * 0.1, (i + 1) * 0.1
            inside = [(y, p) for y, p in part if p >= lo and (p < hi if i < 9 else p <= 1.0)]
            if inside:
                ece += abs(sum(y for y, _ in inside) - sum(p for _, p in inside)) / len(part)
        assert abs(err[g].ece - ece) < 1e-9
        assert abs(err[g].brier - sum((p - y) ** 2 for y, p in part) / len(part)) < 1e-9


def test_auc_without_a_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, prob double")
    assert metrics.roc_auc(df).first().roc_auc == 0.0


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,), (0.7,), (1.2,)], "p double")
    assert [r[0] for r in df.select(metrics.confidence_bin(F.col("p"))).collect()] == [2, 3, 9, 0, 6, None]


def test_suite_with_one_class(spark):
    df = spark.createDataFrame([("test_random", 0, 0.1), ("test_random", 0, 0.2)], "suite string, label int, prob double")
    r = metrics.url_suite_matrix(df).first()
    assert (r.TP, r.FP, r.TN, r.FN, r.roc_auc, r.accuracy, r.status) == (0, 0, 0, 0, 0.0, 100.0, "INVESTIGATE")


def test_risk(spark):
    ps = [0.05, 0.35, 0.68, 0.94, 0.245, 0.5, -0.5, 2.0, 0.255]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("s", risk.risk_score(F.col("p")))
    got = [(r.s, r.t) for r in df.withColumn("t", risk.severity(F.col("s"))).collect()]
    assert got == [(5, "LOW"), (35, "MEDIUM"), (68, "HIGH"), (94, "CRITICAL"), (24, "LOW"), (50, "HIGH"), (0, "LOW"),
                   (100, "CRITICAL"), (26, "MEDIUM")]


def test_message_heuristic(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (3.0, 0.0, 0.0, 0.0)],
                               "urgency_score double, account_threat double, credential_request double, has_shortened_url double")
    assert [r[0] for r in df.select(risk.message_heuristic_score()).collect()] == [0.3, 0.05]
    assert [round(r[0], 2) for r in df.select(risk.message_heuristic_score("intended")).collect()] == [0.99, 0.4]
    with pytest.raises(ValueError):
        risk.message_heuristic_score("other")


def isotonic(points):
    """Pool adjacent violators over (x, y) pairs."""
    blocks = []
    for x in sorted({x for x, _ in points}):
        ys = [y for a, y in points if a == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_calibration_equals_brute_force(spark):
    df, rows = scored(spark, 600)
    df = df.withColumn("probability", array_to_vector(F.array(1.0 - F.col("prob"), F.col("prob"))))
    model = fit_calibrator(df)
    want = isotonic([(p, y) for y, p, _ in rows])
    for r in model.transform(df).select("prob", "calibrated").distinct().collect():
        assert abs(r.calibrated - want[r.prob]) < 1e-9
    ends = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 2.0],)], "a array<double>").select(array_to_vector("a").alias("probability"))
    low, high = [r.calibrated for r in model.transform(ends).collect()]
    assert (low, high) == (min(want.values()), max(want.values()))


def test_markdown(spark):
    df = spark.createDataFrame([("b", 2.5), ("a", 1.0)], "name string, v double")
    lines = [r.line for r in markdown_rows(df, {"name": "**%s**", "v": "%.2f%%"}, ["name"]).orderBy("line_no").collect()]
    assert lines == ["| name | v |", "| :--- | :---: |", "| **a** | 1.00% |", "| **b** | 2.50% |"]
