import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from msgshield.operators import joins, ordering, splits, terms
from msgshield.operators.dedup import cluster_templates, keep_first, keep_first_numbered, template_stats
from msgshield.operators.filters import filter_computed
from msgshield.operators.quality import decode_statistics, duplicate_report, quality_audit


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 8])
def test_sequential_id(spark, partitions):
    rng = random.Random(1)
    keys = rng.sample(range(-10**6, 2**62), 500) + list(range(100))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(partitions)
    for bits in (8, 16):
        rows = ordering.sequential_id(df, "k", "n", start=1, bits=bits).collect()
        assert {r.k: r.n for r in rows} == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_formatted_id(spark):
    df = spark.createDataFrame([(42,), (1234567,)], "n long")
    assert [r[0] for r in df.select(ordering.formatted_id("MSG", F.col("n"))).collect()] == ["MSG_000042", "MSG_1234567"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_rank_cutoffs_on_a_hot_stratum(spark, partitions):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(partitions)
    df = df.withColumn("h", ordering.shuffle_key(42, F.col("id")))
    got = ordering.rank_cutoffs(df, ["s"], "h", {"a": lambda n: F.floor(n * 0.1), "b": lambda n: F.least(n, F.lit(50))})
    got = {r.s: (r.a, r.b) for r in got.collect()}
    for s in {r[1] for r in rows}:
        hashes = sorted(md5(42, i) for i, x in rows if x == s)
        k = int(len(hashes) * 0.1)
        assert got[s] == (hashes[k - 1] if k else None, hashes[min(len(hashes), 50) - 1])


def test_rank_cutoffs_without_quota(spark):
    df = spark.createDataFrame([(1, "a")], "id long, s string").withColumn("h", ordering.shuffle_key(1, F.col("id")))
    assert ordering.rank_cutoffs(df, ["s"], "h", {"a": lambda n: F.lit(0)}).collect() == []


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
def test_weight_cutoff(spark, fraction):
    rng = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rng.randint(0, 150)}" for _ in range(800)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("d", ordering.shuffle_key(42, F.col("k")))
    cut, total, taken = ordering.weight_cutoff(df, "d", fraction)
    order = sorted({md5(42, k): k for k in keys}.items())
    before, want, rows = 0, None, 0
    for digest, key in order:
        if before >= int(len(keys) * fraction):
            break
        want, before = digest, before + keys.count(key)
        rows = before
    assert (cut, total, taken) == (want, len(keys), rows)


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(g, x, rng.randint(0, 9)) for g in "ab" for x in {rng.random() ** 8 for _ in range(700)}]
    df = spark.createDataFrame(rows, "g string, x double, v long")
    got = {(r.g, r.x): r.v_before for r in ordering.prefix_sums(df, ["g"], "x", ["v"], buckets=16).collect()}
    for g in "ab":
        run = 0
        for x, v in sorted((x, v) for h, x, v in rows if h == g):
            assert got[g, x] == run
            run += v


def test_windows_stay_small_for_keys_with_any_gaps(spark):
    """No digit of a key has more than 65,536 values below one of the digit above."""
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    rows = ordering.sequential_id(keys, "k", "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.k)] == list(range(3000))
    assert len(ordering.integer_digits(F.col("k"))) == 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_members(spark, broadcast):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(900)], "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, v long")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        inside, outside = joins.members(rows, table, "k"), joins.non_members(rows, table, "k")
        keys = {r.k for r in table.collect()}
        assert sorted(r.id for r in inside.collect()) == sorted(r.id for r in rows.collect() if r.k in keys)
        assert sorted(r.id for r in outside.collect()) == sorted(r.id for r in rows.collect() if r.k not in keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("partitions", [1, 8])
def test_keep_first(spark, partitions):
    rows = [(i, "hot" if i % 3 else f"t{i % 7}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "ordinal long, text string, label int").repartition(partitions)
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    assert {r.text: r.ordinal for r in keep_first(df, "text", "ordinal").collect()} == first
    numbered = keep_first_numbered(df, "text", "ordinal", "n")
    assert {r.text: r.n for r in numbered.collect()} == {t: n for n, t in enumerate(sorted(first, key=first.get), 1)}
    plan = keep_first(df, "text", "ordinal")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_templates(spark):
    texts = ["pay 1 now", "hello", "Pay 22 now", "hello", "pay 3 now"]
    df = spark.createDataFrame([(i * 10, t, i % 2, f"C{i}") for i, t in enumerate(texts)],
                               "ordinal long, cleaned_text string, label int, channel string")
    got = {r.ordinal: r.template_id for r in cluster_templates(df).collect()}
    assert got == {0: 0, 10: 1, 20: 0, 30: 1, 40: 0}
    from msgshield.functions.text import template_skeleton

    stats = template_stats(df.withColumn("template_skeleton", template_skeleton(F.col("cleaned_text"))))
    assert sorted((r.template_id, r.size, r.label, r.channel) for r in stats.collect()) == [(0, 3, 0, "C0"), (1, 2, 1, "C1")]


def test_filter_computed_is_not_pushed_down(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7).withColumn("w", F.col("v") * 2)
    kept = filter_computed(df, F.col("w") == 4)
    assert kept.columns == ["id", "v", "w"]
    assert [r.id for r in kept.orderBy("id").collect()] == [i for i in range(100) if i % 7 == 2]


def message_rows(spark, n=2000):
    rng = random.Random(9)
    rows = [(i, rng.choice(["EMAIL", "SMS"]), rng.randint(0, 1), f"t{rng.randint(0, 300)}" if i % 3 else "hot") for i in range(n)]
    return spark.createDataFrame(rows, "ordinal long, channel string, label int, template_skeleton string"), rows


@pytest.mark.parametrize("partitions", [1, 8])
def test_template_split(spark, partitions):
    df, rows = message_rows(spark)
    got = {r.ordinal: r.split for r in splits.split_templates(df.repartition(partitions)).collect()}
    assert len(got) == len(rows)
    sides = {}
    for i, _, _, t in rows:
        sides.setdefault(t, set()).add(got[i] == "test_b")
    assert all(len(s) == 1 for s in sides.values())
    n_b = sum(s == "test_b" for s in got.values())
    assert n_b >= int(len(rows) * 0.1)
    rest = len(rows) - n_b
    for channel in ("EMAIL", "SMS"):
        for label in (0, 1):
            group = sorted((md5(42, i), i) for i, c, l, _ in rows if (c, l) == (channel, label) and got[i] != "test_b")
            k = int(len(group) * ((len(rows) * 0.1) / rest))
            names = [got[i] for _, i in group]
            assert names == ["test_a"] * k + ["validation"] * k + ["train"] * (len(group) - 2 * k)


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "id long, label int")
    got = splits.balanced_sample(df, "id", cap=30).collect()
    for label in (0, 1):
        order = sorted((i for i in range(500) if int(i % 10 == 0) == label), key=lambda i: md5(42, i))
        assert sorted(r.id for r in got if r.label == label) == sorted(order[:30])
    few = splits.balanced_sample(df.filter("label = 0 or id < 50"), "id", cap=None).collect()
    assert sum(r.label for r in few) == 5 and len(few) == 10
    assert splits.balanced_sample(df.filter("label = 0"), "id", cap=None).count() == 0


def test_first_per_class(spark):
    df = spark.createDataFrame([(i * 3, "a" if i % 4 else "b") for i in range(400)], "ordinal long, source string")
    got = splits.first_per_class(df, ["source"], 20).collect()
    for s in "ab":
        assert sorted(r.ordinal for r in got if r.source == s) == [i * 3 for i in range(400) if ("a" if i % 4 else "b") == s][:20]


def test_unseen_keys(spark):
    rows = [(i, f"d{i % 40}.com" if i % 3 else "hot.com") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, domain string")
    df = df.withColumn("digest", ordering.shuffle_key(42, F.col("domain")))
    order = sorted(md5(42, d) for d in {d for _, d in rows})
    assert splits.unseen_keys(df, "digest", 0.15) == order[int(len(order) * 0.15) - 1]
    assert splits.unseen_keys(df, "digest", 0.0) is None and splits.unseen_keys(df.limit(0), "digest", 0.5) is None


def test_leak_check(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert [r.k for r in joins.leaked_keys(a, b, "k").collect()] == ["y"]
    joins.assert_no_leak(a.filter("k = 'x'"), b, "k")
    with pytest.raises(ValueError):
        joins.assert_no_leak(a, b, "k")


def test_external_label(spark):
    df = spark.createDataFrame([("ham", "1"), ("spam", "0"), ("odd", "1"), ("1", "0")], "final_label string, label string")
    assert [r.label for r in joins.map_external_label(df).collect()] == [0, 1, 1]
    assert [r.label for r in joins.map_external_label(df.select("label")).collect()] == [1, 0, 1, 0]
    with pytest.raises(ValueError):
        joins.map_external_label(df.select(F.lit(1).alias("x")))


def test_duplicate_report(spark):
    rows = [(i, "u1" if i % 3 else f"v{i}", i % 2, f"f{i}.png") for i in range(30)] + [(100, "v0", 0, "z.png")]
    df = spark.createDataFrame(rows, "ordinal long, normalized_url string, label int, image_filename string").repartition(8)
    got = sorted(tuple(r) for r in duplicate_report(df).collect())
    assert got == [("u1", 20, 10, 10, 1, "f1.png;f2.png;f4.png;f5.png;f7.png"), ("v0", 2, 2, 0, 0, "f0.png;z.png")]


def test_empty_reports(spark):
    from msgshield.functions.fixed import QR_RAW_COLUMNS
    from msgshield.sources.readers import qr_schema

    empty = spark.createDataFrame([], qr_schema(QR_RAW_COLUMNS))
    row = decode_statistics(empty).first()
    assert row.total_images == 0 and row.overall_decode_rate == 0.0 and row.unique_urls == 0
    clean = spark.createDataFrame([], "cleaned_text string, message_length int, channel string")
    assert quality_audit(clean).first().overall == 0.0


def test_quality_audit(spark):
    df = spark.createDataFrame([("abc", 3, "SMS"), ("abc", 3, "SMS"), ("x", 1, "FAX"), ("long", 4, "EMAIL")],
                               "cleaned_text string, message_length int, channel string")
    r = quality_audit(df).first()
    assert (r.rows, r.completeness, r.uniqueness, r.validity, r.channel_validity, r.overall) == (4, 100.0, 75.0, 75.0, 75.0, 81.25)


def test_tfidf_against_brute_force(spark):
    import math

    docs = {0: "win cash now win", 1: "cash on x hand", 2: "hello there", 3: "win win win cash cash"}
    df = spark.createDataFrame(list(docs.items()), "doc long, text string")
    words = {d: [w for w in t.split() if len(w) > 1] for d, t in docs.items()}
    grams = {d: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for d, w in words.items()}
    for size, sublinear in ((1000, False), (3, True)):
        total, dfreq = {}, {}
        for g in grams.values():
            for t in g:
                total[t] = total.get(t, 0) + 1
            for t in set(g):
                dfreq[t] = dfreq.get(t, 0) + 1
        vocab = sorted(total, key=lambda t: (-total[t], t))[:size]
        want = {}
        for d, g in grams.items():
            w = {t: (1 + math.log(g.count(t)) if sublinear else g.count(t)) * (math.log(5 / (1 + dfreq[t])) + 1) for t in set(g) & set(vocab)}
            norm = math.sqrt(sum(x * x for x in w.values()))
            want.update({(d, t): x / norm for t, x in w.items()})
        got = {(r.doc, r.term): r.weight for r in terms.tfidf(df, "doc", "text", size, sublinear).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_shuffles_only_for_the_vocabulary(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} other text {i}") for i in range(50)], "doc long, text string").repartition(3)
    plan = terms.tfidf(df, "doc", "text", 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RoundRobin" in plan
    assert terms.tfidf(df.limit(0), "doc", "text").collect() == []
    assert terms.tfidf(df.withColumn("text", F.lit(None).cast("string")), "doc", "text").collect() == []


def test_token_attribution(spark):
    weights = spark.createDataFrame([(1, "a1", 0.5), (1, "b1", 0.5), (1, "a1 b1", 9.0), (1, "c1", 0.9), (2, "a1", 1.0)],
                                    "doc long, term string, weight double")
    coef = spark.createDataFrame([("a1", 1.0), ("b1", 1.0), ("c1", -1.0), ("a1 b1", 1.0)], "term string, coefficient double")
    got = sorted(tuple(r) for r in terms.token_attribution(weights, coef, "doc", top=2).collect())
    assert got == [(1, 1, "a1", 0.5), (1, 2, "b1", 0.5), (2, 1, "a1", 1.0)]


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (0, 5.0, 5.0), (1, 7.0, 5.0)], "label int, x double, c double")
    rows = terms.standardize(df, df, ["x", "c"]).collect()
    assert [round(r.x, 6) for r in rows] == [-1.341641, -0.447214, 0.447214, 1.341641] and all(r.c == 0.0 for r in rows)
    assert {r.label: r.weight for r in terms.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}
    assert {r.label: round(r.weight, 9) for r in terms.class_weights(df, inverse=True).collect()} == {0: 0.25, 1: 0.75}
    assert {r.x: r.weight for r in terms.with_class_weight(df).collect()} == {1.0: 4 / 6, 3.0: 4 / 6, 5.0: 4 / 6, 7.0: 2.0}


def test_word_and_pair_counts(spark):
    """Totals and documents of words and neighbouring pairs; what leaves a batch is one row a term."""
    texts = ["win cash win cash", "", None, "one win", "cash", "a bb cc bb cc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    expected = {"": (0, len(texts))}
    for text in texts:
        words = re.findall(r"\w{2,}", text or "")
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for term in set(found):
            total, docs = expected.get(term, (0, 0))
            expected[term] = total + found.count(term), docs + 1
    apart = terms._counted(terms.with_terms(df, "text"), "terms")
    together = terms._counted(terms.with_terms(df, "text", bigrams=False), "terms", pairs=True)
    for counted in (apart, together):
        assert {r.term: (r.total, r.df) for r in counted.collect()} == expected
        assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
