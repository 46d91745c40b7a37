"""Bounded samples, isotonic regression of many rows, histogram boosting, model bundles."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from msgshield.operators import isotonic, sampling
from msgshield.session import stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1, 2, 999, 2500, 4999, 5000, 9000])
def test_bottom_rows_are_those_of_a_sort(spark, rows):
    df = stored(spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 2).alias("label")), "urls")
    got = sampling.bottom_rows(df, rows, "url")
    assert "TakeOrdered" not in plan_of(got)
    want = df.orderBy(F.xxhash64("url"), "url").limit(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [1, 5, 700, 1003, 1999])
def test_bottom_rows_with_a_hot_key(spark, rows):
    """One key holds most rows, with a few hundred copies of each of three rows."""
    df = [("hot", i % 3, None if i % 2 else "x") for i in range(1800)] + [(f"k{i}", i, "y") for i in range(200)]
    df = stored(spark.createDataFrame(df, "key string, v int, note string"), "hot")
    got = sampling.bottom_rows(df, rows, "key").collect()
    assert len(got) == rows
    ranks = {r["key"]: r["h"] for r in df.select("key", F.xxhash64("key").alias("h")).distinct().collect()}
    want = df.orderBy(F.xxhash64("key"), "key").limit(rows).collect()
    assert sorted(ranks[r["key"]] for r in got) == sorted(ranks[r["key"]] for r in want)
    assert sorted(map(str, got)) == sorted(map(str, sampling.bottom_rows(df, rows, "key").collect()))


def pool_all(x, y):
    """Plain pool adjacent violators over sorted distinct scores: the fitted value of each."""
    xs, start = np.unique(x, return_index=True)
    order = np.argsort(x, kind="stable")
    total = np.add.reduceat(y[order], np.searchsorted(x[order], xs))
    weight = np.diff(np.append(np.searchsorted(x[order], xs), len(x)))
    blocks = []
    for i in range(len(xs)):
        blocks.append([float(total[i]), float(weight[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + n]
    return xs, np.repeat([t / w for t, w, _ in blocks], [n for *_, n in blocks])


def fitted_at(model, xs, spark):
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = rows.withColumn("probability", array_to_vector(F.array(1.0 - F.col("x"), F.col("x"))))
    return {r["x"]: r["calibrated"] for r in model.transform(rows).collect()}


@pytest.mark.parametrize("case", ["noise", "falling", "rising", "few scores", "one score"])
def test_isotonic_equals_plain_pooling(spark, case):
    r = random.Random(4)
    x = [r.random() for _ in range(3000)]
    if case == "few scores":
        x = [round(v, 1) for v in x]
    if case == "one score":
        x = [0.25] * 3000
    y = [float({"falling": v < 0.5, "rising": v >= 0.5}.get(case, r.random() < v)) for v in x]
    df = spark.createDataFrame([*zip(x, y, strict=True), (None, 1.0), (0.3, None)], "p double, label double")
    for most in (isotonic.FINAL_POOLS, 3):
        model = isotonic.fit_isotonic(df, F.col("p"), F.col("label"), most)
        xs, want = pool_all(np.array(x), np.array(y))
        got = fitted_at(model, xs, spark)
        assert max(abs(got[float(a)] - b) for a, b in zip(xs, want, strict=True)) < 1e-9


def test_isotonic_of_three_million_rows(spark):
    """The pools of all rows, without a bound on them; what the driver gets is far smaller."""
    n = 3_000_000
    p = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = spark.range(n).select(p.alias("p"), (F.pmod(F.xxhash64(F.lit("label"), "id"), F.lit(1000)) / 1000.0 < F.pow(p, 2)).cast("double").alias("label"))
    found = isotonic.pools(rows, F.col("p"), F.col("label"))
    assert found.count() < 20_000
    model = isotonic.fit_isotonic(rows, F.col("p"), F.col("label"))
    data = rows.toPandas()
    xs, want = pool_all(data["p"].to_numpy(), data["label"].to_numpy())
    some = np.linspace(0, len(xs) - 1, 5000).astype(int)
    got = fitted_at(model, xs[some], spark)
    assert max(abs(got[float(xs[i])] - want[i]) for i in some) < 1e-9


def test_isotonic_without_rows(spark):
    with pytest.raises(ValueError):
        isotonic.fit_isotonic(spark.createDataFrame([], "p double, label double"), F.col("p"), F.col("label"))


def test_bundle_versions(spark, tmp_path):
    """The pointer is written last: a version that was not completed is not seen, the newest complete one is read."""
    from pyspark.ml import PipelineModel

    from msgshield.sources import writers

    path = str(tmp_path / "bundle")
    assert not writers.has_bundle(path)
    rows = spark.createDataFrame([(i / 10, float(i > 4)) for i in range(10)], "p double, label double")
    model = PipelineModel(stages=[isotonic.fit_isotonic(rows, F.col("p"), F.col("label"))])
    writers.save_bundle(model, path)
    assert writers.has_bundle(path)
    with pytest.raises(ValueError):
        writers.load_bundle_metrics(path)
    report = spark.createDataFrame([(1, 0.25, "x"), (2, None, None)], "z int, a double, m string")
    writers.save_bundle(model, path, report)
    model.write().save(f"{path}/99999999999999999999-unfinished/model")
    assert writers.load_bundle_metrics(path).columns == ["z", "a", "m"]
    assert sorted(map(str, writers.load_bundle_metrics(path).collect())) == sorted(map(str, report.collect()))
    probs = rows.withColumn("probability", array_to_vector(F.array(1.0 - F.col("p"), F.col("p"))))
    assert writers.load_bundle(path).transform(probs).collect() == model.transform(probs).collect()


def plain_boost(x, y, w, cuts, iterations, depth, leaf, step, l2):
    """Trees as nested tuples, found by looking at every split of every node."""
    base = np.log((w * y).sum() / (w * (1 - y)).sum())
    margin = np.full(len(y), base)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        change = np.zeros(len(y))

        def grow(rows, level):
            change[rows] = -step * g[rows].sum() / (h[rows].sum() + l2)
            best = (1e-9, 0, 0.0)
            if level < depth:
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if min(len(left), len(right)) >= leaf:
                            gain = round((score(left) + score(right) - score(rows)) / 2, 9)
                            if gain > best[0]:
                                best = (gain, f, c)
                if best[0] > 1e-9:
                    grow(rows[x[rows, best[1]] <= best[2]], level + 1)
                    grow(rows[x[rows, best[1]] > best[2]], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + change
    return 1 / (1 + np.exp(-margin))


def test_boosting_equals_plain_trees(spark, tmp_path, monkeypatch):
    from pyspark.ml import PipelineModel

    from msgshield.operators import boosting

    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    r = np.random.default_rng(6)
    x = np.stack([r.integers(0, 6, 400), r.random(400), r.integers(0, 2, 400), np.zeros(400)], axis=1)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 0.6) ^ (r.random(400) < 0.1)).astype(float)
    w = np.where(y > 0, 1.5, 0.75)
    rows = [(*map(float, a), int(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
    names = ["a", "b", "c", "d"]
    df = stored(spark.createDataFrame([*rows, (0.0, 0.0, 0.0, 0.0, None, 1.0)], "a double, b double, c double, d double, label int, w double"), "rows")
    cuts = boosting.cutoffs(df.filter("label IS NOT NULL"), names, 8)
    for i in range(4):
        ranks = sorted(x[:, i])
        assert cuts[i] == sorted({ranks[int(np.ceil(k * 400 / 8)) - 1] for k in range(1, 8)})
    model = boosting.boost(df.filter("label IS NOT NULL"), names, weight="w", iterations=5, depth=3, leaf=10, step=0.3, bins=8)
    want = plain_boost(x, y, w, cuts, 5, 3, 10, 0.3, boosting.L2)
    vectors = df.filter("label IS NOT NULL").withColumn("features", array_to_vector(F.array(*names)))
    path = str(tmp_path / "trees")
    PipelineModel(stages=[model]).write().save(path)
    for fitted in (model, PipelineModel.load(path)):
        got = {(q["a"], q["b"], q["c"]): (q["probability"][1], q["prediction"]) for q in fitted.transform(vectors).collect()}
        for row, p in zip(rows, want, strict=True):
            assert abs(got[row[:3]][0] - p) < 1e-9 and got[row[:3]][1] == float(p > 0.5)
    assert ((want > 0.5) == (y > 0)).mean() > 0.8


def test_boosting_of_one_class_and_no_rows(spark):
    from msgshield.operators import boosting

    df = spark.createDataFrame([(1.0, 1), (None, 1)], "a double, label int")
    for rows, p in ((df, 1.0), (df.withColumn("label", F.lit(0)), 0.0), (df.limit(0), 0.5)):
        model = boosting.boost(rows, ["a"], iterations=2)
        probe = spark.createDataFrame([([0.5],)], "f array<double>").select(array_to_vector("f").alias("features"))
        assert abs(model.transform(probe).first()["probability"][1] - p) < 1e-9
