"""Chat collapse, shards, mixing and licences: against their SQL, and on small tables of odd rows."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from msgshield.llm import chat, licences, mixing, queries, shards

NATIVE = ["op3_chat_collapse", "op5_hash_tree_shards", "op6_systematic_mix", "op8_licence_scan"]
DOCS = "doc_id long, text string, lang string, source string"
ODD = [
    (1, "one two three", "en", "a"), (1, "one two three", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
    (None, "no id here", "en", None), (None, None, None, None), (7, " \t\n ", "en", "b"), (8, "word " * 50_000, "en", "b"),
    (9, "Ünïcode wörds", "de", "\U0001f600"), (9, "another text", "de", "￮"),
]


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", NATIVE)
def test_query_equals_its_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall()))


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf, name):
    assert no_python(queries.QUERIES[name](spark, sf))


def test_chat_prefixes_copies_and_odd_rows(spark):
    a, b, c, d = ("user", "hi"), ("bot", "hello"), ("user", "bye"), ("user", "other")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, d], 5: [a, b, c], 6: [d], 7: [(None, None), (None, "x")], 8: [(None, None)]}
    rows = [(k, t, *turn, "clash") for k, turns in logs.items() for t, turn in enumerate(turns)]
    rows += [(3, 0, *a, "clash"), (None, 0, "user", "nameless", "clash"), (9, None, "user", "no number", "clash")]
    log = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, __n string")
    got = {r["conv_id"]: r for r in chat.collapse_and_render(log).collect()}
    assert set(got) == {3, 4, 6, 7, None, 9}
    assert got[3]["n_copies"] == 1 and got[3]["n_turns"] == 3
    assert got[3]["text"] == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    )
    assert got[7]["text"] == "<|im_start|>\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert chat.collapse_and_render(log.limit(0)).collect() == []


def test_chat_long_conversation_in_parts(spark):
    long = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    prefix = long.filter("turn < 2500").withColumn("conv_id", F.lit(2))
    other = long.filter("turn < 2500").withColumn("conv_id", F.lit(3)).withColumn(
        "text", F.when(F.col("turn") == 1100, "changed").otherwise(F.col("text"))
    )
    got = chat.collapse_and_render(long.unionByName(prefix).unionByName(other)).collect()
    assert {r["conv_id"] for r in got} == {1, 3}
    parts = sorted((r["part"], r["text"]) for r in got if r["conv_id"] == 1)
    assert [p for p, _ in parts] == list(range(47))
    assert "".join(t for _, t in parts) == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(3000))


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 5, "x") for r in ODD], DOCS + ", shard int, __digest string")
    got = shards.shard_documents(docs).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [t or "" for i, t, *_ in ODD if i == r["doc_id"]]
        assert r["text_crc32"] in {zlib.crc32(t.encode()) for t in texts} and r["size"] in {len(t.encode()) + 8 for t in texts}
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.shard_documents(docs.limit(0)).collect() == []


def test_shards_move_only_within_changed_subtrees(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    tree = shards.topology(24)
    heavier = [shards.Shard(s.region, s.rack, s.number, 2.0 if s.number == 3 else 1.0) for s in tree]
    lighter = [s for s in tree if s.number != 17]
    both = rows.select(
        shards.descend(F.col("key"), tree).alias("now"), shards.descend(F.col("key"), heavier).alias("up"),
        shards.descend(F.col("key"), lighter).alias("down"), shards.descend(F.col("key"), shards.topology(31)).alias("more"),
        shards.descend(F.col("key"), shards.topology(30)).alias("less"),
    ).collect()
    region = {s.number: s.region for s in tree}
    counts = [sum(r["now"] == s for r in both) for s in range(24)]
    assert 700 < min(counts) and max(counts) < 960
    assert all(r["more"] in (r["less"], 30) for r in both)
    # Inside the untouched region nothing moves but rows that leave it for the heavier one.
    for r in both:
        if region[r["now"]] == "r0":
            assert region[r["up"]] == "r0"
        elif r["up"] != r["now"]:
            assert region[r["up"]] == "r0"
        if region[r["now"]] == "r0":
            assert r["down"] == r["now"]
    assert 17 not in {r["down"] for r in both}


def fill(sizes, weights):
    """Targets by dealing and dealing again."""
    left, open_, target = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if 2 * sizes[i] <= weights[i] * level}
        for i in full or open_:
            target[i] = 2 * sizes[i] if full else weights[i] * level
            left -= target[i] if full else 0
        open_ -= full or set(open_)
    return target


def test_mix_targets_and_copies(spark):
    names = [None if i == 12 else f"s{i}" for i in range(13)]
    rows = [(i, "w " * (1 + (i * i) % 300), "en", names[(i * 7) % 13 if i % 3 else 0]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in order]
    expected = fill(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, expected, strict=True):
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size}
        assert abs(own[0]["target"] - target) < 1e-6
        assert abs(sum(r["taken"] for r in own) - target) <= 300 + 1e-9
        assert all(r["copies"] in (int(target / size), int(target / size) + 1) and r["copies"] <= 2 for r in own)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 3) for r in ODD], DOCS + ", size string, copies int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD)
    assert sorted(r["size"] for r in got) == sorted(len((r[1] or "").split()) for r in ODD)
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    out = mixing.emit(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} <= {"x"}
    assert mixing.mix(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, "", "en", "a"), (2, None, "en", "a")], DOCS)
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_size_classes_keep_order(spark):
    rows = spark.range(70_000).select("id", mixing.size_class(F.col("id")).alias("c")).orderBy("id").collect()
    assert all(0 <= b["c"] - a["c"] <= 1 for a, b in zip(rows, rows[1:]))
    assert [r["c"] for r in rows[:300]] == [*range(256), *[256 + (i - 256) // 2 for i in range(256, 300)]]


def test_licence_notices_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", "print(1)"), (3, "a/b/c/y.py", "code\n# " + apache.upper() + "\nmore"),
        (4, "a/b/z.py", None), (5, "d/e.py", "text of the public domain work"), (6, None, mit), (7, None, None),
        (8, "LICENSE", "no notice at all"), (9, "a/b/copying.txt", "first\nsecond " + apache), (10, "a/b/c/d/e/f.py", ""),
        (10, "a/b/c/d/e/f.py", ""), (11, "ab/x.py", "x"), (12, "a/LICENSE.old", mit + " " + "other words entirely here " * 3),
        (13, "q/long.txt", "word " * 100_000 + "\n" + mit),
    ]
    files = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "file_id int, path string, text string, licence string, dir double")
    got = sorted((r["file_id"], r["licence"], r["effective"], r["from_dir"]) for r in licences.scan_files(files).collect() if True)
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == ("MIT", "MIT", None) and by_id[2] == (None, "MIT", "a")
    assert by_id[3] == ("Apache-2.0", "Apache-2.0", None)
    assert by_id[4][1:] == by_id[10][1:] and by_id[4][1] in ("MIT", "Apache-2.0")
    assert by_id[5] == (None, None, None) and by_id[6] == ("MIT", "MIT", None) and by_id[7] == (None, None, None)
    assert by_id[8] == (None, None, None) and by_id[11] == (None, None, None) and by_id[13][0] == "MIT"
    assert licences.scan_files(files.limit(0)).collect() == []


def test_licence_headers_of_several_lines_and_texts(spark):
    def gnu(name, version, mark):
        lines = [
            "This program is free software: you can redistribute it and/or modify", f"it under the terms of the GNU {name} as published by",
            f"the Free Software Foundation, either version {version} of the License, or", "(at your option) any later version.",
        ]
        return "x = 1\n" + "\n".join(mark + x for x in lines) + "\n" + mark + "\ndef f():\n    return x\n"

    bsd = "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage main\n"
    apache = " " * 20 + "Apache License\n" + " " * 15 + "Version 2.0, January 2004\n" + " " * 12 + "http://www.apache.org/licenses/\n\n"
    apache += "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n" + "further terms of it follow here\n" * 200
    mit = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
    rows = [
        ("m/LICENSE", mit, "MIT"), ("a/LICENSE", apache, "Apache-2.0"), ("a/notes.txt", apache, None), ("m/x.py", "print(1)", None),
        ("m/g3.py", gnu("General Public License", "3", "# "), "GPL-3.0"), ("m/g2.py", gnu("General Public License", "2", " * "), "GPL-2.0"),
        ("m/l3.py", gnu("Lesser General Public License", "3", ""), "LGPL-3.0"), ("m/a3.py", gnu("Affero General Public License", "3", "; "), "AGPL-3.0"),
        ("m/b.go", bsd, "BSD-3-Clause"), ("m/mit.c", "/*\n" + mit.replace("\n", "\n * ") + "*/ int x;", "MIT"),
        ("m/far.py", bsd.replace("BSD-style\n", "BSD-style\n" + "other words entirely stand between these two lines\n" * 30), None),
    ]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "file_id int, path string, text string")
    got = {r["path"]: (r["licence"], r["effective"], r["from_dir"]) for r in licences.scan_files(files).collect()}
    for path, _, licence in rows:
        top = path.split("/")[0]
        above = {"m": "MIT", "a": "Apache-2.0"}[top]
        assert got[path] == ((licence, licence, None) if licence else (None, above, top)), path


def test_licence_key_terms_lose_nothing():
    vectors = licences.template_vectors(100, {t: 3 for t in licences.VOCABULARY})
    keys = set(licences.key_terms(vectors, 0.8))
    for v in vectors:
        assert sum(w * w for t, w in v.items() if t not in keys) < 0.8**2
