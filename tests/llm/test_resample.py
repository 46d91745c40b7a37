"""Importance resampling: hashes and tables against plain versions, the query against its SQL, odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from msgshield.llm import ngrams, queries, resample, sql

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Hello, World! a b a b a", None, "", "ünï Ço 12 x", "w" * 300 + " tail " + "v" * 127 + " " + "u" * 128 + " q q",
    " ".join(random.Random(5).choice(["aa", "bb", "ccc", "Dé"]) for _ in range(4000)), "...", "one",
]


def runs(text):
    words = WORD.findall((text or "").encode().lower())
    return words, Counter(b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of every (doc_id, text)."""
    counts = []
    for texts in ([t for _, t in docs], target):
        found = Counter()
        for text in texts:
            for gram, n in runs(text)[1].items():
                found[zlib.crc32(gram) % 10000] += n
        counts.append(found)
    s, t = counts
    total_s, total_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for doc_id, text in docs:
        words, grams = runs(text)
        weight = 0
        for gram, n in grams.items():
            b = zlib.crc32(gram) % 10000
            weight += n * math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, sum(grams.values()), weight, score, len(words)))
    order = [x for x in out if x[4] >= 20]
    order.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    rank = {}
    for place, x in enumerate(order[: 5 * len(order) // 100]):
        rank.setdefault(x, []).append(place + 1)
    return [(*x[:4], rank[x].pop(0) if rank.get(x) else None) for x in out]


def test_hashes_equal_the_library():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.randrange(256) for _ in range(9000)) + b"12345678", dtype=np.uint8).copy()
    at = np.array([r.randrange(7000) for _ in range(8000)])
    size = np.array([r.choice([0, 1, 2, 3, 5, 8, 12, 13, 31, 32, 33, 40, 63, 64, 70, 99, 500, r.randrange(900)]) for _ in at])
    spans = [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
    assert ngrams.xxh64(data, at, size).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]
    assert ngrams.crcs(data, at, size).tolist() == [zlib.crc32(x) for x in spans]


def test_equal_keys_do_not_join_different_bytes():
    data = np.frombuffer(b"abcabdabcab" + b" " * 8, dtype=np.uint8).copy()
    at, size = np.array([0, 3, 6, 0, 9]), np.array([3, 3, 3, 2, 2])
    table = ngrams.intern(np.zeros(5, dtype=np.uint64), ngrams.same_bytes(data, at, size))
    assert table.slot[0] == table.slot[2] and table.slot[3] == table.slot[4] and len(set(table.slot.tolist())) == 3
    assert sorted(table.count.tolist()) == [1, 2, 2]


@pytest.mark.parametrize("piece", [1 << 18, 64, 3])
def test_pieces_hold_every_run_once(monkeypatch, piece):
    monkeypatch.setattr(ngrams, "PIECE_WORDS", piece)
    by_row, by_slot = Counter(), Counter()
    for p in ngrams.pieces(pa.array(TEXTS), 3):
        for row, table, crc in zip(p.row, p.tables, p.crc, strict=True):
            by_row.update(zip(row.tolist(), crc[table.slot].tolist(), strict=True))
            for c, n in zip(crc.tolist(), table.count.tolist(), strict=True):
                by_slot[c] += n
    rows, slots = Counter(), Counter()
    for i, text in enumerate(TEXTS):
        for gram, n in runs(text)[1].items():
            rows[i, zlib.crc32(gram)] += n
            slots[zlib.crc32(gram)] += n
    assert by_row == rows and +by_slot == slots


def test_query_equals_its_sql(spark, sf):
    got = queries.QUERIES["op11_importance_resampling"](spark, sf)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    expected = con.sql(sql.RESAMPLE)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall()))


def test_odd_rows_and_ties(spark):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5]), (None, None), (3, "repeated id"), (77, "x" * 200_000)]
    rows += [(100 + i % 40, " ".join(r.choice("abcdef") for _ in range(r.randrange(15, 60)))) for i in range(200)]
    rows += [(500, "same text of words " * 6)] * 60
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, score int, at int")
    target = spark.createDataFrame([(None,), ("",), ("a b c a b c",), ("same text",)], "text string")
    got = [tuple(x) for x in resample.resample(docs, target).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, [None, "", "a b c a b c", "same text"])))
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 5 * sum(len(runs(t)[0]) >= 20 for _, t in rows) // 100 + 1))
    empty = resample.resample(docs.limit(0), target)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    nothing = [tuple(x) for x in resample.resample(docs, target.limit(0)).collect()]
    assert sorted(map(str, nothing)) == sorted(map(str, plain(rows, [])))
    kept = resample.drawn(docs.filter("doc_id >= 77").dropDuplicates(["doc_id"]), target, 50).collect()
    assert kept and all(len(runs(x["text"])[0]) >= 20 for x in kept)
