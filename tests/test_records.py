"""Files read by ranges: CSV with line breaks in fields and JSON arrays, at borders of every kind."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import types as T

from msgshield.sources import readers

TEXTS = ["plain", "", 'say "hi"', "two\nlines", 'a,"b"\n\n"c",', "}{[],", '\\"}', "é  ü", "tab\there", "trailing\n", "\n\n", '"', "\\", "}\n{"]


def messages(n, seed=1):
    r = random.Random(seed)
    return [("".join(r.choice(TEXTS) for _ in range(r.randrange(4))) + f" #{i}", r.randrange(2)) for i in range(n)]


@pytest.fixture(params=["128m", "512", "100", "37"])
def small_ranges(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield request.param
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_at_every_border(spark, tmp_path, small_ranges, indent):
    rows = messages(60)
    for name, part in (("a", rows[:25]), ("b", []), ("c", rows[25:])):
        objects = [{"text": t, "label": k, "more": [1, "x}"]} for t, k in part]
        (tmp_path / f"{name}.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    got = readers.read_messages_json(spark, str(tmp_path / "*.json"))
    if small_ranges != "128m":
        assert got.rdd.getNumPartitions() > 4
    assert sorted((r.ordinal, r.text, r.label) for r in got.collect()) == [(i, *r) for i, r in enumerate(rows)]


def test_nested_objects_are_an_error(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"text": "a", "deep": {"x": 1}, "label": 1}]')
    with pytest.raises(Exception, match="flat objects"):
        readers.read_messages_json(spark, str(tmp_path / "n.json")).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_at_every_border(spark, tmp_path, small_ranges, end):
    rows = messages(60, 2)
    out = io.StringIO()
    table = csv.writer(out, lineterminator=end)
    table.writerow(["label", "extra", "text"])
    table.writerows([k, "x,y", t] for t, k in rows[:20])
    (tmp_path / "a.csv").write_bytes(("﻿" + out.getvalue() + end).encode())
    out = io.StringIO()
    table = csv.writer(out, lineterminator=end)
    table.writerow(["label", "extra", "text"])
    table.writerows([k, "", t] for t, k in rows[20:])
    (tmp_path / "b.csv").write_bytes(out.getvalue().removesuffix(end).encode())
    raw = readers._csv_rows(spark, str(tmp_path), True)
    if small_ranges != "128m":
        assert raw.rdd.getNumPartitions() > 4
    got = sorted((r['__ordinal'], r.text, int(r.label)) for r in raw.collect())
    assert got == [(i, *r) for i, r in enumerate(rows)]
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    assert sorted(map(tuple, readers.read_csv_table(spark, str(tmp_path), schema).collect())) == sorted(rows)


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        readers._csv_rows(spark, str(tmp_path), True).collect()
