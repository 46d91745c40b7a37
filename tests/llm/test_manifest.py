"""The Merkle manifest: against its SQL, against a plain version, and on odd rows."""

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from msgshield.llm import merkle, queries, sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, at int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}

    def tree(name, nodes):
        levels[name] = [nodes]
        while len(levels[name][-1]) > 1:
            below = levels[name][-1]
            levels[name].append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
        return levels[name][-1][0]

    subroots = [tree(("source", s), [x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order]
    root = tree("top", subroots)
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            folded = leaf
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf_of(row[0], row[1].replace("\n", ""), *row[2:])
            proof = ""
            for name, at in ((("source", s), i), ("top", k)):
                for nodes in levels[name][:-1]:
                    before, after = "".join(nodes[at - at % 3 : at]), "".join(nodes[at + 1 : at - at % 3 + 3])
                    proof, folded, at = proof + before + after, h(before + folded + after), at // 3
            out.append((row[0], leaf, subroots[k], root, h(proof), folded, folded == root))
    return out


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS)
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    return got


def test_query_equals_its_sql(spark, sf):
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(sql.manifest_sql())
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall())
    assert {r["verified"] for r in got.collect()} == {True, False}


def test_blocks_of_large_sources(spark):
    rows = [(i * 7 % 5003, f"text\n{i}", "en", "hot", i) for i in range(5003)]
    rows += [(i, f"a\nb {i}", None, f"s{i % 30}", None) for i in range(90)]
    got = compare(spark, rows)
    assert len({r[3] for r in got}) == 1 and 0.3 < sum(r[6] for r in got) / len(got) < 0.7


def test_odd_rows(spark):
    rows = [
        (1, "same", "en", "a", 4), (1, "same", "en", "a", 4), (1, "other", "en", "a", 5), (2, None, None, "a", None),
        (3, "", "", "", 0), (None, "nameless\n", "en", None, 1), (None, None, None, None, None), (5, "x" * 300_000, "en", "b", 1),
        (-4, "Ünïcode \n\n", "de", "\U0001f600", 9), (7, "wörds", "de", "￮", 2), (8, "\n", "en", None, 1),
    ]
    compare(spark, rows)
    compare(spark, [(2**40, "alone\n", "en", "a", 6)])
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28, 100])
def test_missing_nodes_are_enough_and_no_more(count):
    levels = merkle.climb([h(str(i)) for i in range(count)], merkle.height(count))
    assert len(levels[-1]) == 1
    for held in ({0}, {count - 1}, set(range(count)), set(range(0, count, 4)), {count // 2, count // 2 + 1} & set(range(count))):
        if not held:
            continue
        lacks = merkle.missing(held, 0, count)
        known = {(0, i): levels[0][i] for i in held} | {(level, i): levels[level][i] for level, i in lacks}
        assert len(known) == len(held) + len(lacks)
        for level in range(len(levels) - 1):
            for run in {i // 3 for k, i in list(known) if k == level}:
                members = [known[level, i] for i in range(3 * run, min(3 * run + 3, len(levels[level])))]
                assert (level + 1, run) not in known, "an asked node could be derived"
                known[level + 1, run] = h("".join(members))
        assert known[len(levels) - 1, 0] == levels[-1][0]


def test_proofs_stand_alone(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 4}", 2, "", 0) for i in range(60)], DOCS)
    rows = merkle.proofs(docs, F.lit(""), F.lit(False)).collect()
    assert all(r["folded_root"] == r["root"] for r in rows) and len({len(r["proof"]) for r in rows}) <= 4
