import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgshield.functions.fixed import MESSAGE_FEATURES
from msgshield.plans import evaluation, messages, qr, scoring, training, urls
from msgshield.session import remove_intermediate, shared_dir, stored
from msgshield.sources import readers, writers
from msgshield.streaming.ingest import ingest_decodes, read_ingested
from msgshield.streaming.scoring import stream_score, write_scores


def test_clean_corpus_job(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(
        '[{"text": "Subject: hello &amp; bye", "label": 0}, {"text": "line one\\nline, \\"two\\"", "label": 1},'
        '{"text": "Subject: hello & bye", "label": 1}, {"label": 1}, {"text": "http://a.b/c", "label": 1},'
        '{"text": "<html>x</html>", "label": 0}, {"text": "kept out", "label": 7}]'
    )
    out = str(tmp_path / "out")
    result = messages.build_clean_messages(spark, str(source), out)
    assert {r.reason: r.rows for r in result["purge_counts"].collect()} == {"kept": 3, "empty": 1, "raw_url": 1, "html": 1}
    audit = result["audit"].first()
    assert audit.rows == 2 and audit.overall == 100.0
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["channel=EMAIL", "channel=SMS"]


def test_clean_corpus_does_not_depend_on_partitions(spark):
    rows = [(i, f"message {i % 40} &lt; x", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "ordinal long, text string, label int")
    a, b = (sorted(map(tuple, messages.clean_messages(df.repartition(n)).collect())) for n in (1, 8))
    assert a == b and len(a) == 40
    assert [r[0] for r in a] == [f"MSG_{i:06d}" for i in range(1, 41)]


def test_external_holdout(spark):
    ext = spark.createDataFrame([(0, " dup ", "ham"), (1, "dup", "spam"), (2, "known", "ham"), (3, "ab", "ham"), (4, None, "ham"),
                                 (5, "odd", "x"), (6, "good one", "smishing")], "ordinal long, cleaned_text string, final_label string")
    master = spark.createDataFrame([("known ",)], "cleaned_text string")
    rows = messages.external_holdout(ext, master).collect()
    assert sorted((r.ordinal, r.label, r.label_name, r.channel) for r in rows) == [(0, 0, "Legitimate", "SMS"), (6, 1, "Phishing", "SMS")]


def url_rows(spark, n=600):
    rows = []
    for i in range(n):
        bad = i % 2
        host = f"{'secure-login' if bad else 'www'}.site{i % 60}.{'xyz' if bad else 'org'}"
        rows.append((f"http{'' if bad else 's'}://{host}/{'verify/account' if bad else 'wiki/page'}/{i}?x={'%20' * (i % 5)}", bad,
                     "qr_decoded" if i % 3 == 0 else "existing_url", i))
    return spark.createDataFrame(rows, "raw_url string, label int, source string, ordinal long")


def test_corpus_priority(spark):
    rows = [("http://a.com", 1, "existing_url", 0), ("A.com/", 0, "existing_url", 9), ("http://a.com", 0, "qr_decoded", 1),
            ("http://b.com", 1, "qr_decoded", 0), ("b.com", 0, "qr_decoded", 5), ("", 0, "existing_url", 3)]
    df = spark.createDataFrame(rows, "raw_url string, label int, source string, ordinal long")
    got = sorted((r.normalized_url, r.raw_url, r.label, r.source) for r in urls.url_corpus(df).collect())
    assert got == [("http://a.com/", "A.com/", 0, "existing_url"), ("http://b.com/", "b.com", 0, "qr_decoded")]


def test_corpus_has_no_silent_cap(spark):
    rows = spark.range(15_001).select(
        F.format_string("http://h%d.com/", "id").alias("raw_url"), F.lit(0).alias("label"), F.lit("existing_url").alias("source"),
        F.col("id").alias("ordinal"),
    )
    assert urls.url_corpus(rows).count() == 15_001
    assert urls.url_corpus(rows, 10).count() == 10


def test_input_order_does_not_depend_on_packing(spark, tmp_path):
    """Ids and splits follow file names and positions, whatever the sizes of files and of input blocks."""
    texts = [f"message number {i} of template {i % 90}" for i in range(3003)]
    (tmp_path / "a.json").write_text("".join(f'{{"text": "{t}", "label": {i % 2}}}\n' for i, t in enumerate(texts[:3])))
    (tmp_path / "b.json").write_text("".join(f'{{"text": "{t}", "label": {i % 2}}}\n' for i, t in enumerate(texts[3:])))
    found = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            raw = readers.read_messages_json(spark, str(tmp_path / "*.json"), lines=True)
            assert [r.text for r in raw.orderBy("ordinal").collect()] == texts
            assert [r.ordinal for r in raw.orderBy("ordinal").collect()] == list(range(3003))
            clean = stored(messages.clean_messages(raw), "clean")
            splits = messages.message_splits(clean)
            found.append(sorted((r.message_id, r.cleaned_text, r.split) for r in splits.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]
    out = str(tmp_path / "splits")
    messages.write_message_splits(splits, out)
    assert spark.read.parquet(out).count() == len(found[0])
    leaking = splits.withColumn("split", F.when(F.col("ordinal") % 2 == 0, "test_b").otherwise("train"))
    with pytest.raises(ValueError):
        messages.write_message_splits(leaking, out)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    p = tmp_path / "swapped.csv"
    p.write_text("b,extra,a\nB1,x,1\n,y,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert [tuple(r) for r in readers.read_csv_table(spark, str(p), schema).collect()] == [(1, "B1"), (None, "")]
    with pytest.raises(ValueError):
        readers.read_csv_table(spark, str(p), T.StructType([T.StructField("c", T.StringType())]))


def test_url_job_stops_at_a_leak(spark, tmp_path):
    splits = urls.url_splits(stored(urls.url_corpus(url_rows(spark)), "corpus"))
    urls.assert_unseen_domains(splits)
    planted = splits.withColumn("split", F.when(F.col("normalized_url").contains("/1?"), "test_unseen_domain").otherwise(F.col("split")))
    with pytest.raises(ValueError):
        urls.assert_unseen_domains(planted)


def test_filters_reach_a_stored_decode_table(spark, tmp_path):
    qr.qr_payload_tables(spark, decodes(spark), str(tmp_path / "o"))
    raw = spark.read.parquet(str(tmp_path / "o" / "raw"))
    for name in ("urls", "failed"):
        plan = writers.route_decodes(raw)[name]._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull" in plan


def test_intermediate_tables_can_be_removed(spark, sf):
    import __spark_entry__ as entry

    entry.queries()["template_split"](spark, sf).count()
    root = os.path.dirname(shared_dir(spark, "x")).removeprefix("file:")
    assert os.listdir(root)
    remove_intermediate(spark)
    assert not os.path.exists(root)


def test_model_scores_determine_the_rest(spark, sf):
    """Tier, action, sentence and advice follow from the returned probability."""
    import duckdb

    import __spark_entry__ as entry
    from msgshield.functions.fixed import MESSAGE_POLICY, URL_POLICY

    tier = "CASE WHEN risk_score <= 24 THEN 'LOW' WHEN risk_score <= 49 THEN 'MEDIUM' WHEN risk_score <= 79 THEN 'HIGH' ELSE 'CRITICAL' END"
    for name, prob, policy, place in (
        ("score_urls_model", "calibrated_p_malicious", URL_POLICY, 0), ("score_messages_model", "calibrated_probability", MESSAGE_POLICY, 1),
    ):
        rows = entry.queries()[name](spark, sf).toPandas()
        actions = " ".join(f"WHEN '{k}' THEN '{v[place]}'" for k, v in policy.items())
        bad = duckdb.sql(
            f"SELECT count(*) FILTER (abs(risk_score - {prob} * 100) > 0.51 OR severity <> {tier} OR action <> CASE severity {actions} END), count(*) FROM rows"
        ).fetchall()[0]
        assert bad[0] == 0 and bad[1] > 0
        assert rows["explanation"].str.len().min() > 10


def test_url_splits(spark):
    corpus = stored(urls.url_corpus(url_rows(spark)), "corpus")
    splits = urls.url_splits(corpus)
    rows = splits.collect()
    assert len(rows) == corpus.count() == 600
    parts = {}
    for r in rows:
        parts.setdefault(r.split, set()).add(r.root_domain)
    unseen = parts.pop("test_unseen_domain")
    assert len(unseen) == int(60 * 0.15)
    assert all(not (unseen & other) for other in parts.values())
    assert set(parts) == {"train", "validation", "test_random", "test_qr_unseen"}
    assert all(r.source == "qr_decoded" for r in rows if r.split == "test_qr_unseen")
    suites = urls.test_suites(splits)
    temporal = suites.filter(F.col("suite") == "test_temporal").collect()
    assert temporal and {r.split for r in temporal} == {"test_random"}
    assert sum(r.label for r in temporal) * 2 == len(temporal)


@pytest.mark.parametrize("booster", ["gbt", "newton"])
def test_url_model_bundle(spark, tmp_path, booster):
    splits = stored(urls.url_splits(stored(urls.url_corpus(url_rows(spark)), "corpus")), "splits")
    train, validation = (splits.filter(F.col("split") == s) for s in ("train", "validation"))
    bundle, report = training.train_and_calibrate(train, validation, iterations=3, depth=3, leaf=5, booster=booster)
    row = report.first()
    assert row.accuracy > 90 and row.roc_auc > 0.9 and 0 <= row.calibrated_ece <= row.raw_ece + 1e-9
    path = str(tmp_path / "bundle")
    writers.save_bundle(bundle, path)
    test = splits.filter(F.col("split") == "test_random")
    a = sorted(map(tuple, training.predict_urls(bundle, test).collect()))
    assert a == sorted(map(tuple, training.predict_urls(writers.load_bundle(path), test).collect()))
    out = str(tmp_path / "report")
    matrix = {r.suite: r for r in evaluation.evaluate_urls(bundle, urls.test_suites(splits), out).collect()}
    assert set(matrix) == {"test_random", "test_unseen_domain", "test_qr_unseen", "test_temporal"}
    assert matrix["test_random"].samples == test.count()
    lines = [r.value for r in spark.read.text(f"{out}/url_benchmark_md").collect()]
    assert len(lines) == 25 and lines[6].startswith("| **Test 1 (Standard Stratified Random)** | ")
    assert lines[11] == "## 2. Confusion Matrix & False Negative Breakdown"
    counts = matrix["test_random"]
    assert lines[15] == f"| Test 1 (Standard Stratified Random) | {counts.TP} | {counts.FP} | {counts.TN} | {counts.FN} |"
    scored = scoring.score_urls(test.select("raw_url"), model=bundle).collect()
    assert len(scored) == test.count() and all(0 <= r.risk_score <= 100 for r in scored)


@pytest.mark.parametrize("classifier", ["logistic", "perceptron"])
def test_message_model(spark, tmp_path, classifier):
    rows = [(f"urgent verify your password {i} now" if i % 2 else f"lunch at noon with team {i}", "SMS", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "cleaned_text string, channel string, label int")
    model = training.fit_message_model(df, "hybrid", size=50, classifier=classifier, hidden=8)
    out = training.predict_messages(model, df).collect()
    assert sum(r.pred == r.label for r in out) > 110
    path = str(tmp_path / "m")
    writers.save_bundle(model, path)
    again = training.predict_messages(writers.load_bundle(path), df).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    tests = df.withColumn("split", F.when(F.col("label") == 0, "test_a").otherwise("test_c"))
    levels = {r.level: r.samples for r in evaluation.evaluate_messages(model, tests, str(tmp_path / "r")).collect()}
    assert levels == {"Overall Master Test Set": 60, "Channel: SMS": 60, "Test A (Standard Stratified)": 60,
                      "Test C (External Unseen Dataset)": 60}
    scored = scoring.score_messages(df.withColumn("text", F.col("cleaned_text")), model=model)
    assert {r.prediction for r in scored.filter("label = 1").collect()} == {"MALICIOUS"}


def _few_messages(spark):
    words = "urgent verify password lunch noon team invoice gift call meeting".split()
    rows = [(" ".join(words[(i * k + k * k) % 10] for k in range(1, 8)) + f" {i % 7}!", "SMS" if i % 3 else "EMAIL", int(i % 5 < 2)) for i in range(90)]
    return spark.createDataFrame(rows, "cleaned_text string, channel string, label int").repartition(2, "cleaned_text")


def test_stages_share_one_word_count(spark, monkeypatch):
    """Three models from messages counted once are those fitted apart, and tests counted once get the same scores."""
    df, calls, fit = _few_messages(spark), [], training.fit_vocabulary
    monkeypatch.setattr(training, "fit_vocabulary", lambda *a, **b: calls.append(1) or fit(*a, **b))
    monkeypatch.setattr(training, "_vocabulary_size", lambda kind: 60 if kind == "baseline" else 25)
    kinds = ["baseline", "semantic", "hybrid"]
    counted = training.count_messages(df, kinds)
    tests = counted.count(df, kinds, "tests")
    for kind in kinds:
        shared, apart = training.fit_message_model(counted, kind), training.fit_message_model(df, kind)
        assert shared.stages[3].vocabulary == apart.stages[3].vocabulary == counted.names[: 60 if kind == "baseline" else 25]
        text, counts, other = (
            {(r.cleaned_text, r.channel): r.prob for r in training.predict_messages(m, rows).collect()}
            for m, rows in ((shared, df), (shared, tests), (apart, df))
        )
        assert text.keys() == counts.keys() and all(abs(text[k] - counts[k]) < 1e-12 and abs(text[k] - other[k]) < 1e-3 for k in text)
    assert len(calls) == 4


def test_solver_does_not_read_the_text(spark, monkeypatch):
    """What scaling and the solver read again and again is a stored table of counts and signals."""
    seen, fit = [], training.Pipeline.fit
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, rows, *a: seen.append(rows) or fit(self, rows, *a))
    training.fit_message_model(_few_messages(spark), "hybrid", size=30)
    assert set(seen[0].columns) == {"label", "counts", *MESSAGE_FEATURES}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "model_text" not in plan


def test_vector_and_table_tfidf_agree(spark):
    from msgshield.operators.terms import tfidf

    rows = [(0, "win cash now win"), (1, "cash in hand"), (2, "win win cash cash")]
    df = spark.createDataFrame(rows, "doc long, model_text string")
    for sublinear in (False, True):
        stages = training.tfidf_stages(df, 100, sublinear)
        out = df
        for stage in stages:
            out = stage.transform(out)
        words = stages[3].vocabulary
        got = {(r.doc, words[i]): float(v) for r in out.collect() for i, v in enumerate(r.tfidf.toArray()) if v}
        want = {(r.doc, r.term): r.weight for r in tfidf(df, "doc", "model_text", 100, sublinear).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_score_qr_failure(spark):
    df = spark.createDataFrame([(1, " http://bit.ly/x "), (2, None), (3, "  ")], "i int, payload string")
    rows = {r.i: r for r in scoring.score_qr(df).collect()}
    assert (rows[1].success, rows[1].severity, rows[1].source) == (True, "MEDIUM", "qr_decoded")
    assert rows[1].decoded_text == "http://bit.ly/x" and rows[1].error is None
    for i in (2, 3):
        assert (rows[i].success, rows[i].risk_score, rows[i].severity, rows[i].action) == (False, 0, "UNKNOWN", "ERROR")
        assert rows[i].normalized_url is None and rows[i].error.startswith("No QR code")


def test_score_urls_text(spark):
    df = spark.createDataFrame([(0, "http://1.2.3.4/login"), (1, "https://example.com/")], "i int, raw_url string")
    a, b = scoring.score_urls(df).orderBy("i").collect()
    assert (a.risk_score, a.severity, a.action) == (70, "HIGH", "QUARANTINE")
    assert [i.title for i in a.indicators] == ["Direct IP Address Host", "Unencrypted Protocol (HTTP)", "Authentication Credential Trap Detected"]
    assert a.suspicious_tokens == ["1.2.3.4", "login"]
    assert a.explanation == "Flagged as HIGH Risk (70/100) due to 3 structural anomalies and phishing indicators."
    assert (b.severity, [i.level for i in b.indicators], b.suspicious_tokens) == ("LOW", ["INFO"], [])


def test_readers(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_bytes(b"\xef\xbb\xbfx,URL,label,z\n1, http://a.b ,0,q\n2,\"http://c,\nd\",1,q\n3,http://e,2,q\n4\n5,u\xffv,1,q\n")
    got = sorted((r.raw_url, r.label) for r in readers.read_url_csv(spark, str(p)).collect())
    assert got == [("http://a.b", 0), ("http://c,\nd", 1), ("uv", 1)]
    q = tmp_path / "v.csv"
    q.write_text("first,lab,last\nhttp://a,1,x\n")
    assert [(r.raw_url, r.label) for r in readers.read_url_csv(spark, str(q)).collect()] == [("http://a", 1)]
    b = tmp_path / "b.csv"
    b.write_text("Evaluation Level,Samples,Accuracy (%),Macro F1 (%),Precision (%),Recall (%),Target,Status,TP,FP,TN,FN\n"
                 "Overall,5,97.3,1,2,3,>= 95.0%,PASS,1,2,3,4\n")
    assert readers.read_benchmark_csv(spark, str(b)).first().TN == 3


def test_image_manifest(spark, tmp_path):
    for folder, names in {"benign": ["b.PNG", "a b.jpg", "x.txt"], "malicious": ["z.webp", "c+d.png", "n.gif"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"0")
    folders = {"benign": (str(tmp_path / "benign"), 0), "malicious": (str(tmp_path / "malicious"), 1)}
    rows = [(r.qr_id, r.image_filename, r.source_folder, r.label) for r in readers.image_manifest(spark, folders).orderBy("qr_id").collect()]
    assert rows == [("QR_000001", "a b.jpg", "benign", 0), ("QR_000002", "b.PNG", "benign", 0), ("QR_000003", "c+d.png", "malicious", 1),
                    ("QR_000004", "z.webp", "malicious", 1)]
    capped = readers.image_manifest(spark, folders, limit=2)
    assert sorted(r.image_filename for r in capped.collect()) == ["a b.jpg", "c+d.png"]
    done = spark.createDataFrame([("z.webp",), (None,)], "image_filename string")
    assert readers.pending_files(capped.unionByName(capped), done).count() == 4
    assert all(os.path.exists(r.image_path) for r in readers.image_manifest(spark, folders).collect())


def decodes(spark, n=40):
    rows = [(f"QR_{i:06d}", f"f{i}.png", f"/x/f{i}.png", "benign", i % 2, None if i % 7 == 0 else f"http://A.com/{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "qr_id string, image_filename string, image_path string, source_folder string, label int, payload string")


def test_qr_job(spark, tmp_path):
    out = str(tmp_path / "qr")
    qr.qr_payload_tables(spark, decodes(spark), out)
    counts = {n: spark.read.parquet(f"{out}/{n}").count() for n in ("raw", "urls", "failed")}
    assert counts == {"raw": 40, "urls": 34, "failed": 6}
    assert [len(spark.read.parquet(f"{out}/{n}").columns) for n in ("raw", "urls", "failed")] == [26, 21, 6]
    lines = [r.value for r in spark.read.text(f"{out}/report").collect()]
    assert "Total images:             40" in lines and "Overall decode rate:      85.00%" in lines
    dup = spark.read.option("header", True).csv(f"{out}/duplicates").collect()
    assert len(dup) == 5


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    decodes(spark).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    for kind, column in (("urls", "payload"), ("messages", "payload"), ("qr", "payload")):
        scored = stream_score(stream, kind, column)
        out = str(tmp_path / f"out-{kind}")
        write_scores(scored, out, str(tmp_path / f"cp-{kind}")).awaitTermination()
        batch = stream_score(spark.read.parquet(src), kind, column)
        got = spark.read.schema(scored.schema).parquet(out)
        key = lambda r: str(r)
        assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_ingest_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    df = decodes(spark)
    first, second = df.filter("qr_id < 'QR_000020'"), df.filter("qr_id >= 'QR_000020'")

    def run():
        stream = spark.readStream.schema(df.schema).parquet(src)
        ingest_decodes(stream, out, cp).awaitTermination()
        return read_ingested(spark, out).count(), read_ingested(spark, out, "urls").count(), read_ingested(spark, out, "failed").count()

    first.coalesce(1).write.parquet(src)
    assert run() == (20, 17, 3)
    assert run() == (20, 17, 3)
    second.coalesce(1).write.mode("append").parquet(src)
    assert run() == (40, 34, 6)


def test_append_only_pending(spark, tmp_path):
    path = str(tmp_path / "done")
    files = spark.createDataFrame([(f"f{i}.png", i) for i in range(10)], "image_filename string, i int")
    writers.append_rows(files.filter("i < 4"), path)
    for _ in range(2):
        writers.append_rows(readers.pending_files(files, spark.read.parquet(path)).select("image_filename", "i"), path)
        assert sorted(r.i for r in spark.read.parquet(path).collect()) == list(range(10))


def test_shared_dir():
    from types import SimpleNamespace

    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    named = session("yarn", **{"spark.checkpoint.dir": "hdfs://host/work"})
    assert shared_dir(named, "x").startswith("hdfs://host/work/msgshield-app-1/x-")
    assert os.path.isdir(os.path.dirname(os.path.dirname(shared_dir(session("local[2]"), "x"))))
    with pytest.raises(ValueError):
        shared_dir(session("yarn"), "x")


def test_base64(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",)], "b string")
    assert [bytes(r[0]) for r in df.select(readers.base64_payload(F.col("b"))).collect()] == [b"hi", b"hi"]
