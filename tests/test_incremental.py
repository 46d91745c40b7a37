"""Work that follows only what is new: capped reading, stored digests, report partials."""

import shutil

import pytest
from pyspark.sql import functions as F

from msgshield.operators import joins, quality
from msgshield.plans import qr
from msgshield.session import stored
from msgshield.sources import readers
from msgshield.streaming.ingest import resume_decodes


@pytest.mark.parametrize("n, files", [(1, 1), (10, 4), (40, 8), (10_000, 8)])
def test_capped_reading_stops_early(spark, tmp_path, n, files):
    """Eight files of 20 rows, label 1 only in the last half of each; groups of 1, 1, 2 and 4 files or so."""
    rows = [(f"http://h{i}.com/", int(i % 20 >= 10)) for i in range(160)]
    for k in range(8):
        part = rows[20 * k : 20 * k + 20]
        (tmp_path / f"f{k}.csv").write_text("URL,label\n" + "".join(f"{u},{y}\n" for u, y in part))
    size = (tmp_path / "f0.csv").stat().st_size
    found, used = readers.read_capped(spark, str(tmp_path), readers.read_url_csv, n, group_bytes=size + 10)
    got = sorted((r.ordinal, r.raw_url, r.label) for r in found.collect())
    want = [(i, u, y) for i, (u, y) in enumerate(rows) if sum(1 for v, z in rows[:i] if z == y) < n]
    assert got == want
    assert len(used) <= files and (n > 1 or len(used) == 1)


def test_stored_digests_stay_where_they_are(spark, tmp_path):
    texts = [(f"text {i % 700}",) for i in range(1000)] + [(None,), ("",)]
    master = spark.createDataFrame(texts, "t string")
    batch = spark.createDataFrame([(i, f"text {i}") for i in range(690, 720)] + [(-1, ""), (-2, None)], "i int, t string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joins.store_digests(master, "t", "known_texts", str(tmp_path / "d"), 16)
        for table in ("known_texts", "opened_texts"):
            if table == "opened_texts":
                joins.open_digests(spark, table, str(tmp_path / "d"), 16)
            left = joins.exclude_stored(batch, table, "t")
            assert sorted(r.i for r in left.collect()) == list(range(700, 720))
            assert sorted(map(str, left.collect())) == sorted(map(str, joins.exclude_known(batch, master, "t").collect()))
            plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            # One exchange, on the batch; none above the scan of the digests.
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS known_texts")
        spark.sql("DROP TABLE IF EXISTS opened_texts")


def decodes(spark, numbers):
    def payload(i):
        return ["https://a.com/x", "https://b.com/y?z=1", f"http://c{i}.com", "no link here", None][i % 5]

    rows = [
        (i, f"QR_{i:06d}", f"img{i}.png", f"/q/img{i}.png", "malicious" if i % 3 else "benign", int(i % 3 > 0), payload(i),
         None if payload(i) else "no_qr_detected_or_unreadable")
        for i in numbers
    ]
    schema = "ordinal long, qr_id string, image_filename string, image_path string, source_folder string, label int, payload string, decode_error string"
    return spark.createDataFrame(rows, schema)


def test_partials_merge_to_the_whole(spark):
    raw = stored(qr.qr_raw_table(decodes(spark, range(200))), "raw")
    parts = None
    for k in range(3):
        part = quality.decode_partials(qr.with_ordinal(raw.filter(F.col("ordinal") % 3 == k)), "ordinal")
        parts = part if parts is None else parts.unionByName(part)
    merged = stored(quality.merge_partials(parts), "merged")
    assert quality.statistics_of(merged).collect() == quality.decode_statistics(raw).collect()
    whole = quality.duplicate_report(qr.with_ordinal(qr.successful_urls(raw)))
    got = quality.duplicates_of(merged)
    assert got.columns == whole.columns and got.count() == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_second_delivery_reads_no_rows_of_the_first(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = decodes(spark, range(120))
    for late in (False, True):
        rows.filter((F.col("ordinal") >= 60) == late).write.mode("append").parquet(source)
        resume_decodes(spark.readStream.schema(rows.schema).parquet(source), out, checkpoint)
        if not late:
            for table in ("raw", "urls", "failed"):
                shutil.rmtree(f"{out}/{table}/batch=0")
    raw = stored(qr.qr_raw_table(rows), "all")
    want = str(tmp_path / "want")
    qr.rebuild_reports(raw, want)
    for name in ("report", "duplicates"):
        got, expected = ([r.value.replace(p, "") for r in spark.read.text(f"{p}/{name}").collect()] for p in (out, want))
        assert got == expected
