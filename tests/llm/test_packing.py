"""Packing: ids against the tokenizers library, retrieval against plain BM25, pieces as a round trip."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from msgshield.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as file:
    CODER = packing.Coder(file.read())
SCHEMA = "doc_id long, text string, source string, ids string, length int"
ODD = [
    (1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", None), (None, "no id here", None),
    (None, None, None), (7, " \t\n ", "b"), (8, "word and more " * 4000, "b"), (9, "<|endoftext|> inside <|endoftext|>", "c"),
    (10, "x" * 6000, "b"), (11, "Ünïcode 日本語 👩‍👩‍👧", "\U0001f600"),
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def whole(rows, pieces, padding_share):
    """Every id of every document once; offsets without gaps; full sequences but for a few."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    expected = defaultdict(Counter)
    for doc_id, text, *_ in rows:
        expected[doc_id][tuple(ids_of(text))] += 1
    for doc_id, own in docs.items():
        assert sum(r["length"] for r in own) == sum(len(t) * n for t, n in expected[doc_id].items())
        for r in own:
            fits = [t for t in expected[doc_id] if len(t) == r["doc_tokens"]]
            crc = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for t in fits}
            assert r["ids_crc32"] in crc
        if sum(expected[doc_id].values()) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    assert docs.keys() == expected.keys()
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= padding_share * 1024 * len(sequences) + 1024
    return sequences


def test_query_is_a_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    first = queries.QUERIES["op13_retrieval_packing"](spark, sf).collect()
    whole(rows, first, 0.01)
    again = queries.QUERIES["op13_retrieval_packing"](spark, sf).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_odd_rows_and_small_shards(spark):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in ODD], SCHEMA)
    for limit in (packing.SHARD_BYTES, 100):
        found = packing.pack(docs, PATH, shard_bytes=limit)
        rows = found.selectExpr("*", "crc32(ids) AS ids_crc32").collect()
        sequences = whole(ODD, rows, 1.0)
        joined = {r["sequence_id"]: r for r in packing.sequences(found).collect()}
        assert joined.keys() == sequences.keys()
        for key, own in sequences.items():
            ids = b"".join(r["ids"] for r in sorted(own, key=lambda r: r["offset"]))
            n = len(ids) // 4
            assert bytes(joined[key]["ids"]) == ids and joined[key]["n_tokens"] == n
            assert joined[key]["padding"] == (0 if n & (n - 1) == 0 else 1024 - n)
    assert packing.pack(docs.limit(0), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,s1½é　\x1c\x85")), max_size=60))
def test_ids_equal_the_library(text):
    assert CODER.encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_left_to_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        other = file.read()
    assert packing.byte_ranks(json.loads(other)) is None
    expected = Tokenizer.from_str(other).encode("Some Words here", add_special_tokens=False).ids
    assert packing.Coder(other).encode("Some Words here").tolist() == expected


def test_index_equals_plain_bm25():
    r = random.Random(2)
    docs = [np.array([r.choice(range(1, 60)) for _ in range(r.randrange(1, 40))] + [0], dtype="<u4") for _ in range(50)]
    index = packing.Index(docs)
    sets = [Counter(d[:-1].tolist()) for d in docs]
    df = Counter(t for s in sets for t in s)
    mean = sum(map(len, docs)) / len(docs)
    open_ = np.array([i % 3 > 0 for i in range(50)])
    for doc in range(50):
        terms = sorted((t for t in sets[doc] if df[t] > 1), key=lambda t: (df[t], t))[: packing.QUERY_TERMS]
        score = {}
        for i, s in enumerate(sets):
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[i]) / mean)
            found = [math.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) * s[t] * (packing.K1 + 1) / (s[t] + norm) for t in terms if t in s]
            if found and open_[i]:
                score[i] = sum(found)
        got = index.neighbours(doc, open_).tolist()
        assert set(got) == set(score)
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_share_a_window(seed):
    """Documents of one topic lie together, though they come in mixed order."""
    r = random.Random(seed)
    docs = [np.array([r.randrange(100 * (i % 20), 100 * (i % 20) + 100) for _ in range(100)] + [0], dtype="<u4") for i in range(200)]
    together, total = 0, 0
    windows = defaultdict(set)
    for doc, _, _, sequence, _ in packing.fill(docs, 512):
        windows[sequence].add(doc % 20)
    for topics in windows.values():
        total, together = total + 1, together + (len(topics) <= 2)
    assert together / total > 0.9


@pytest.mark.parametrize("dense", [1, 8, 1 << 20])
def test_all_terms_of_a_seed_decide(dense, monkeypatch):
    """Partners that share only the commoner of many terms are found, and in the order of the whole score."""
    monkeypatch.setattr(packing, "DENSE", dense)
    rare, common = np.arange(1, 31), np.arange(100, 160)
    docs = [np.concatenate([x, [0]]).astype("<u4") for x in (
        np.concatenate([rare, common]), rare, np.concatenate([rare[:1], np.arange(300, 400)]),
        common, common[:50], common[:40], common[:1], common[:40], np.arange(500, 560),
    )]
    df = Counter(t for d in docs for t in d[:-1].tolist())
    mean = sum(map(len, docs)) / len(docs)
    score = {}
    for i, d in enumerate(docs[1:], 1):
        norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
        shared = set(d[:-1].tolist()) & set(docs[0][:-1].tolist())
        score[i] = sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * (packing.K1 + 1) / (1 + norm) for t in shared)
    order = sorted((i for i in score if score[i]), key=lambda i: (-score[i], i))
    assert set(order) == {1, 2, 3, 4, 5, 6, 7} and order.index(5) + 1 == order.index(7)
    index = packing.Index(docs)
    open_ = np.ones(len(docs), dtype=bool)
    open_[0] = False
    for closed in (0, 3, 1, 5, 4, 6):
        open_[closed] = False
        left = [i for i in order if open_[i]]
        assert index.neighbours(0, open_).tolist() == left
        for most in (1, 2, 4):
            assert index.neighbours(0, open_, most).tolist() == left[:most]


def test_windows_prefer_the_whole_score():
    """The rarest sixteen terms of the seed lead to the short documents; all its terms lead to its copy in the rest."""
    rare, rest = np.arange(1, 17), np.arange(100, 400)
    one = [np.array([t, 1000 + t, 0], dtype="<u4") for t in rare.tolist()]
    seed = np.concatenate([rare, rest, [0]]).astype("<u4")
    copies = [np.append(rest, 0).astype("<u4") for _ in range(3)]
    pieces = list(packing.fill([seed, *one, *copies], 700))
    assert [doc for doc, *_ in pieces[:3]] == [0, 17, 18]


def test_long_runs_are_found_wherever_they_start():
    for start in (0, 1, 1999, 2000, 2001, 3999):
        for size in (1999, 2000, 3999, 4000, 4001, 9000):
            for run, other in (("x", " "), (" ", "x")):
                text = (other + run) * (start // 2) + other * (start % 2 + 1) + run * size + other
                assert packing.long_run(text) == bool(packing.LONG_RUN.search(text)) == (size >= 4000)
                assert packing.long_run(run * size) == (size >= 4000)
