"""Language model, toxicity, decontamination, near-duplicates and extraction against plain versions and odd rows."""

import collections
import html
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from msgshield.llm import components, decontam, embed, extract, maxent, pages, queries, simhash, toxicity, words

DOCS = "doc_id long, text string, lang string, source string"
ODD = [
    (1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
    (None, "no id here", "en", None), (None, None, None, None), (7, " \t\n ", "en", "b"), (8, "word " * 300_000, "en", "b"),
    (9, "İstanbul \xa0   x", "de", "c"), (1, "another text of one", "de", "c"), (11, "y" * 2_000_000, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2.0) for r in ODD], DOCS + ", print string, n long, score double").repartition(3)


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def low(text):
    return (text or "").encode().lower().split()


# --- words -------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["The the THE", "", None, " a\tb\x0bc\n", "\xa0 é É x" + "z" * 700_000, "a" + " b" * 400_000]
    array = pa.array(["skipped", *texts]).slice(1).fill_null("")
    found = words.split(array)
    expected = [low(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    assert [bytes(found.data[a:b]) for a, b in zip(found.start, found.end)] == flat
    ids = words.hashes(found)
    assert len(set(ids.tolist())) == len(set(flat)) and len(set(zip(ids.tolist(), flat))) == len(set(flat))
    again = np.concatenate([words.hashes(words.split(piece)) for _, piece in words.slices(array, 10)])
    assert np.array_equal(ids, again)
    assert len(words.split(pa.array([], pa.string())).first) == 1


# --- language model ----------------------------------------------------------


def test_base_score_and_model(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op1_maxent_scores(spark, sf).collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in documents}
    counts = collections.Counter(w for d, t in documents if not fold[d] for w in [*low(t), None])
    total = sum(counts.values())
    denominator = math.log10(total + 0.5 * (len(counts) + 1))
    for d, t in documents:
        tokens = [*low(t), None]
        assert got[d]["held_out"] == fold[d] and got[d]["n_tokens"] == len(tokens) and got[d]["train_tokens"] == total
        assert got[d]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert got[d]["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.5) - denominator for w in tokens))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark):
    """Over all known words and the unseen slots of the tail classes the probabilities of the next word sum to one."""
    vocabulary = [f"w{i}" for i in range(700)]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(vocabulary, 60, p=np.arange(1, 701) / 245350)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = maxent.word_counts(docs).persist()
    model = maxent.fit(docs, counts)
    assert np.abs(model.class_rows).max() > 0
    history = "w699 w3 w650"
    seen = sorted({w for t in texts for w in t.split()})
    unseen, tails = [], set()
    for i in range(26 * 26):
        word = f"q{chr(97 + i // 26)}{chr(97 + i % 26)}"
        tail = int(maxent.tokens(pa.array([word])).tail[0])
        if tail not in tails:
            tails.add(tail)
            unseen.append(word)
    assert len(unseen) == maxent.TAIL_CLASSES
    stream = maxent.tokens(pa.array([f"{history} {w}" for w in [*seen, *unseen]]))
    logs = maxent.log_probability(model, maxent.examples(model, stream))[stream.first[:-1] + 3]
    logs[-len(unseen):] += math.log(0.5)
    end = maxent.log_probability(model, maxent.examples(model, maxent.tokens(pa.array([history]))))[3]
    assert np.exp(logs).sum() + math.exp(end) == pytest.approx(1.0, abs=1e-3)
    counts.unpersist()


def test_model_learns_word_order(spark):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(400):
        word, out = 0, []
        for _ in range(80):
            word = (word * 7 + int(rng.integers(0, 3))) % 50
            out.append(f"w{word}")
        texts.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = maxent.language_scores(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.3


def test_language_scores_of_odd_rows(spark, odd):
    got = maxent.language_scores(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(low(r[1])) + 1 for r in ODD)
    assert all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert maxent.language_scores(odd.limit(0)).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    untrained = maxent.language_scores(odd.filter("doc_id = 1").withColumn("doc_id", F.lit(held[0]))).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in untrained} == {(0, 0)} and len(untrained) == 3


# --- toxicity ----------------------------------------------------------------


def sentences(n, seed, toxic):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "ti", "re", "mu") for b in ("lan", "sor", "ten", "vik", "dra")]
    out = []
    for _ in range(n):
        text = rng.choice(plain, rng.integers(20, 120)).tolist()
        if toxic:
            for _ in range(3):
                text[rng.integers(len(text))] = "zgr" + rng.choice(["a", "ok", "umm", "ef"]) + rng.choice(plain)[:2]
        out.append(" ".join(text))
    return out


def test_toxicity_on_held_out_rows(spark):
    texts = sentences(250, 1, True) + sentences(900, 2, False)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5000, "", "en", "s"), (5001, None, "en", "s"), (None, "x", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i < 250)) for i in range(1150)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1150]
    assert np.mean([r["predicted"] == (r["doc_id"] < 250) for r in held]) > 0.97
    # Labels of the held-out fold do not matter.
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity(docs, flipped).collect())) == sorted(map(str, got))
    kept = toxicity.without_toxic(docs.withColumn("__other", F.lit(1)).withColumn("score", F.lit("x")), labels)
    assert kept.columns == [*docs.columns, "__other", "score"] and kept.count() == sum(not r["predicted"] for r in got)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 0, 1), (8, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.toxicity(odd, table).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd.limit(0), labels).collect() == []
    strangers = spark.createDataFrame([(i, 1, i % 2) for i in range(500, 540)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, strangers).collect()} == {0.0}


def test_kneser_ney_sums_to_one():
    texts = pa.array(sentences(40, 3, True) + sentences(40, 4, False))
    model = toxicity.fit_counts(texts, np.repeat([1, 0], 40))
    for history in ("", "z", "zgr", "balanx"):
        starts = words.split(pa.array([history + "q"]))
        gram, size, _ = toxicity.grams(starts, np.array([0]))
        g, n = gram[len(history)], size[len(history)]
        every = (g & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        shared = toxicity._shared_probability(model, every, np.full(256, n))[:, None]
        left = model.left[toxicity._find(model.histories, every >> np.uint64(8))]
        p = model.kept[toxicity._find(model.grams, every)] + left * shared
        assert p.sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


# --- decontamination ---------------------------------------------------------


def bare(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def plain_hits(docs, items):
    longest = max(len(bare(t)) for _, t in items)

    def parts(text):
        found = list(re.finditer(rb"[0-9a-z\x80-\xff]+", text.lower().encode()))
        w = [m[0] for m in found]
        for cut in range(len(w) - 1, 0, -1):
            if found[cut - 1].string[found[cut - 1].end() :][:1] in (b".", b"?", b"!", b":") and len(w) - cut >= 5:
                return [w[:cut], w[cut:]] if cut >= 5 else [w]
        return [w]

    def runs(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    out = set()
    wanted = [(i, [(min(5, len(p)), runs(p, min(5, len(p)))) for p in parts(t)]) for i, t in items if bare(t)]
    for d, t in docs:
        w = bare(t)
        n = -(-len(w) // longest)
        for s in range(max(1, n - 2)):
            window = w[s * longest : (s + 3) * longest]
            have = {g: runs(window, g) for g in range(1, 6)}
            out |= {(d, i) for i, ps in wanted if all(len(x & have[g]) >= 0.8 * len(x) for g, x in ps)}
    return out


def test_decontamination_equals_brute_force(spark, sf, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = list(documents)
    for k, (_, text) in enumerate(items):
        w = text.split()
        changed = [x if j % 13 != 5 else "changed" for j, x in enumerate(w)]
        shouted = "".join(c.upper() if len(c.upper()) == 1 else c for c in "\n".join(w))
        loud = "before it " * (k % 40) + shouted.replace(".", " ; ").replace(",", "") + " after"
        docs += [(10_000 + k, loud), (20_000 + k, " ".join(changed))]
        docs += [(30_000 + k, " ".join(w[: len(w) // 2])), (40_000 + k, " ".join(w[3:]))]
    rows = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], DOCS).repartition(5)
    got = decontam.hits(rows, spark.read.parquet(f"{sf}/benchmark.parquet"), F.col("doc_id")).collect()
    expected = plain_hits(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    assert {d for d, _ in expected} >= set(range(10_000, 10_000 + len(items)))
    assert all(min(r["question_overlap"], r["answer_overlap"]) >= 0.8 for r in got)


def test_decontamination_in_passes_and_odd_rows(spark, odd, monkeypatch):
    items = [(1, "one two three four"), (2, None), (3, ""), (4, "word word word word word word"), (5, "a b c d e f. g h i j k l"), (6, "x")]
    items += [(100 + i, f"filler{i} text{i} number{i} of{i} item{i} end{i}.") for i in range(30)]
    table = spark.createDataFrame(items, "item_id int, text string")
    docs = odd.unionByName(spark.createDataFrame(
        [(50, "start a b c d e f. g h i j k l end", "en", "s", "", 1, 1.0), (51, "a b c d e f. nothing of that", "en", "s", "", 1, 1.0)], odd.schema))
    one = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.hits(docs, table, F.col("doc_id")).collect())
    assert ("50", 5) in one and ("51", 5) not in one and ("8", 4) in one and one.count(("1", 1)) == 2
    monkeypatch.setattr(decontam, "WORDS_PER_PASS", 40)
    many = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.hits(docs, table, F.col("doc_id")).collect())
    # Shorter indexes look at shorter passages; these items are found either way.
    assert many == one
    kept = decontam.decontaminated(docs, table)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({(d, d) for d, _ in one}) - 1
    assert decontam.hits(docs, table.limit(0), F.col("doc_id")).collect() == []
    assert decontam.hits(docs.limit(0), table, F.col("doc_id")).collect() == []
    assert decontam.decontaminated(docs, table.limit(0)).count() == docs.count()


def test_decontamination_finds_one_changed_word(spark, sf):
    """Every copy of an item with one word replaced that holds 0.8 of the whole item's shingles is a hit, and no other."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()

    def runs(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    whole = {i: (bare(t), runs(bare(t))) for i, t in items}
    longest = max(len(w) for w, _ in whole.values())
    docs, expected = [], {(10**6 + 1, 1)}
    for i, text in items:
        w = text.split()
        for k in range(len(w)):
            docs.append((i * 1000 + k, " ".join([*w[:k], "replaced", *w[k + 1 :]])))
    # Question and answer far apart hold less of the whole, yet both wholly.
    docs.append((10**6 + 1, "a b c d e f " + "between " * 6 + "g h i j k l"))
    items.append((1, "a b c d e f. g h i j k l"))
    for d, text in docs[:-1]:
        w = bare(text)
        assert len(w) <= 2 * longest
        have = runs(w)
        expected |= {(d, i) for i, (_, x) in whole.items() if len(x & have) >= 0.8 * len(x)}
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], DOCS).repartition(4)
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.hits(rows, table, F.col("doc_id")).collect()}
    got = decontam.hits(rows, table, F.col("doc_id"), whole=True).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected | parts and len(got) == len(expected | parts)
    assert len(expected - parts) > 100
    kept = {r["doc_id"] for r in decontam.decontaminated(rows, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected | parts}


@pytest.mark.parametrize("places", [1, 2])
def test_decontamination_finds_copies_at_every_offset(spark, sf, places):
    """Copies of the longest items with six words put in at some places, wherever they begin; checked on whole documents."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf.replace('0.001', '0.1')}/benchmark.parquet'").fetchall()
    items.sort(key=lambda x: -len(bare(x[1])))
    longest = len(bare(items[0][1]))

    def runs(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    docs, expected = [], set()
    for i, text in items[:20]:
        w = [x.decode() for x in bare(text)]
        cuts = [len(w) * (k + 1) // (places + 1) for k in range(places)]
        copy = []
        for k, x in enumerate(w):
            copy += ["inserted"] * (6 * (k in cuts)) + [x]
        if len(runs(w) & runs(copy)) < 0.8 * len(runs(w)):
            continue
        for offset in range(0, 2 * longest, 3):
            docs.append((len(docs), " ".join([f"before{k}" for k in range(offset)] + copy + [f"after{k}" for k in range(4 * longest)])))
            expected.add((len(docs) - 1, i))
    assert len(docs) > 200
    table = spark.createDataFrame(items + [(5_000_000, items[0][1])], "item_id long, text string")
    rows = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], DOCS).repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(rows, table, F.col("doc_id"), whole=True).collect()}
    # A repeated item is hit as often as the first.
    expected |= {(d, 5_000_000) for d, i in expected if i == items[0][0]}
    assert got >= expected
    assert decontam.decontaminated(rows, table).count() == 0


# --- near-duplicates ---------------------------------------------------------


def fingerprint(text):
    w = low(text)
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in runs], dtype=np.uint64)
    return sum(1 << b for b in range(64) if int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h))


def closure(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_equals_brute_force(spark, sf, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_pivot_simhash(spark, sf).collect()}
    prints = [fingerprint(t) for _, t in documents]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = closure(len(prints), near)
    assert got == {d: (f"{p:016x}", documents[g][0]) for (d, _), p, g in zip(documents, prints, group, strict=True)}


@pytest.mark.parametrize("small, block", [(16, 2048), (2, 20)])
def test_simhash_links_lose_nothing(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash, "SMALL_UNIT", small)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(3)]
    chain = [int(base[0])]
    for _ in range(100):
        chain.append(chain[-1] ^ sum(1 << int(k) for k in rng.choice(64, 2, replace=False)))
    prints = sorted({int(b) for b in base} | set(near) | set(chain))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p, p) for p in signed], "print long, node long")
    found = {r["node"]: r["component"] for r in components.components(simhash.links(table)).collect()}
    group = closure(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    expected = collections.defaultdict(set)
    for p, g in zip(signed, group, strict=True):
        expected[g].add(p)
    actual = collections.defaultdict(set)
    for p in signed:
        actual[found.get(p, p)].add(p)
    assert sorted(map(sorted, actual.values())) == sorted(map(sorted, expected.values()))


def test_simhash_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{fingerprint(t):016x}" for _, t, *_ in ODD)
    kept = simhash.drop_near_duplicates(odd)
    rows = [(r["doc_id"], (r["text"] or "")[:20]) for r in kept.collect()]
    assert kept.columns == odd.columns and len(rows) == len(set(rows))
    assert sorted(rows, key=str) == sorted(
        [(1, "one two three four"), (2, ""), (None, "no id here"), (8, ("word " * 9)[:20]), (9, ODD[8][1]), (1, "another text of one"), (11, "y" * 20)], key=str
    )
    assert simhash.near_duplicates(odd.limit(0)).collect() == [] and simhash.drop_near_duplicates(odd.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (7001, 7000), (7000, 7001)]
    table = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(table).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {7000: 7000, 7001: 7000}
    assert components.components(table.limit(0)).collect() == []


def plain_vectors(rows):
    rows = sorted(rows, key=lambda r: r[0])
    ids = [r[0] for r in rows]
    x = [None if r[1] is None or any(v is None or not math.isfinite(v) for v in r[1]) or not any(r[1]) or r[2] is None else np.array(r[1], dtype=float) for r in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b])
        and x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b]) >= 0.93
    ]
    group = closure(len(rows), links)
    counts = collections.Counter(k for pair in links for k in pair)
    return {ids[i]: (counts[i], ids[group[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("cell, block, centroid", [(8192, 1024, 64), (8192, 1024, 8), (20, 16, 8), (5, 3, 4)])
def test_vectors_equal_brute_force(spark, monkeypatch, cell, block, centroid):
    monkeypatch.setattr(embed, "CELL_ROWS", cell)
    monkeypatch.setattr(embed, "CENTROID_ROWS", centroid)
    monkeypatch.setattr(embed, "DEAL_ROWS", 4 * block)
    monkeypatch.setattr(embed, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.25 * rng.normal(size=8)).astype(np.float32).tolist(), i % 3 if i % 5 else 0) for i in range(400)]
    rows += [(400 + i, [3 * v for v in rows[7][1]] if i % 2 else rows[7][1], rows[7][2]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(table).collect()}
    assert got == plain_vectors(rows)
    if centroid < 64:
        dealt, levels = embed.cells(embed.representatives(table)[1], embed.THRESHOLD)
        assert levels >= (2 if cell < 100 else 1)
        assert dealt.select("label", "cell").distinct().count() > 12


def test_cells_decide_on_the_given_vectors(spark, sf):
    """Every label of the larger table has cells, and fewer pairs are compared than there are."""
    classes = embed.representatives(spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet"))[1]
    dealt, levels = embed.cells(classes, embed.THRESHOLD)
    assert levels == 1
    cells = dealt.groupBy("label", "cell").agg(F.sum("home").alias("home"), F.count("*").alias("n")).collect()
    per_label = collections.Counter(r["label"] for r in cells)
    assert min(per_label.values()) >= 2
    everything = sum(r["count"] * (r["count"] - 1) // 2 for r in classes.groupBy("label").count().collect())
    inside = sum(r["home"] * (r["home"] - 1) // 2 + r["home"] * (r["n"] - r["home"]) for r in cells)
    print("pairs compared", inside, "of", everything)
    assert inside <= everything


def test_cells_prune_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=32)).tolist(), 1) for i in range(3000)]
    classes = embed.representatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))[1]
    dealt, _ = embed.cells(classes, embed.THRESHOLD)
    cells = dealt.groupBy("cell").agg(F.sum("home").alias("home"), F.count("*").alias("n")).collect()
    assert sum(r["home"] * (r["home"] - 1) // 2 + r["home"] * (r["n"] - r["home"]) for r in cells) < 0.2 * 3000 * 2999 / 2


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1),
        (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [], 1), (13, [1.0], 1), (14, [1e30, 1e-30], 1),
        (15, [1e-30, 0.0], 1), (16, [-1.0, 0.0], 1), (17, [-0.0, -2.0], 1), (18, [0.0, -2.0], 1),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<float>, label int, cell string, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_vectors(table).collect()}
    assert got == {k: (*v, v[1] == k) for k, v in plain_vectors(rows).items()}
    twice = embed.near_vectors(table.filter("vec_id IN (3, 5)").unionByName(table.filter("vec_id = 3"))).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in twice) == [(3, 2, 3), (3, 2, 3), (5, 2, 3)]
    null_id = embed.near_vectors(table.filter("vec_id = 3").withColumn("vec_id", F.lit(None).cast("int"))).collect()
    assert [tuple(r) for r in null_id] == [(None, 0, None, False)]
    assert embed.near_vectors(table.limit(0)).collect() == []


def test_kmeans_cells_prune(spark):
    """Far clusters fall into cells of their own and vectors do not visit every cell."""
    rng = np.random.default_rng(8)
    centres = np.eye(16)[:6]
    vectors = [(centres[i % 6] + 0.02 * rng.normal(size=16)).tolist() for i in range(600)]
    table = spark.createDataFrame([(0, i, 1, v) for i, v in enumerate(vectors)], "label long, node long, n long, embedding array<double>")
    dealt, levels = embed.cells(table, 0.93)
    assert levels == 1 and len(vectors) <= dealt.count() < 2 * len(vectors)


def test_blocks_hold_every_vector_once(spark, monkeypatch):
    """What is written grows with the vectors, not with the pairs of blocks; no pair of blocks passes a shuffle."""
    monkeypatch.setattr(embed, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(500)]
    rows += [(500 + i, [v * 1.01 for v in rows[i][1]], i % 2) for i in range(0, 500, 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    classes = embed.representatives(table)[1]
    blocks = embed.packed(embed.dealt_once(classes, embed.THRESHOLD)[0])
    packed = blocks.select(F.sum(F.length("embedding") / 64), F.max(F.length("node") / 8), F.count("*")).first()
    assert packed[0] == classes.count() == len(rows) and packed[1] <= 16 and packed[2] > 30
    plan = embed.compare(blocks, embed.THRESHOLD)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(table).collect()}
    assert got == plain_vectors(rows)


# --- extraction --------------------------------------------------------------


def test_pages_equal_a_plain_reading(spark, sf):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op7_suffix_array_extraction(spark, sf).collect()}
    for page_id, source in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        article = re.search("<article>(.*?)</article>", source, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(p for p in parts if p)
        assert got[page_id] == (text, len(text))


def test_markup():
    source = """<html><head><title>T</title><script>if (a < b) { x = "</p>" }</script></head><body class=page>
    <header>Top</header><nav><ul><li>Menu<li>Other</ul></nav><!-- no <p>comment</p> -->
    <main><article data-x="a > b"><header><h1>The&nbsp;title &amp; more</h1></header>
    <p>First <b>bold</b> a&lt;b <span class="ad">buy!</span>end<p>Second<br>line &eacute;&#233;&#x41;
    <aside>aside</aside><div class="cookie-notice"><p>cookies</p></div><form><p>form</p></form>
    <ul><li>one</li><li>two</ul><table><tr><td>a</td><td>b</td></tr></table><div class="promoted-not">kept?</div>
    <style>p{}</style><section id=comments><p>a reader</p></section></article></main>
    <div role="contentinfo">foot</div><footer>Foot</footer></body></html>"""
    article, rest = pages.decided(pages.blocks(source))
    assert [b.text for b in article] == ["The title & more", "First bold a<b end", "Second line ééA", "one", "two", "a b"]
    assert {b.text for b in rest} >= {"Top", "Menu", "Other", "Foot", "foot", "aside", "cookies", "a reader"}
    for broken in ("", "<", "<p", "text", "<p>a<p>b", "</p></div>x", "<a href='x>y</a>z", "<script>never closed", "<!-- open", "&#xD800;&bad;" * 3):
        pages.blocks(broken)
    assert [b.text for b in pages.blocks("<p>a<p>b")] == ["a", "b"]
    assert [b.text for b in pages.decided(pages.blocks("<nav>n</nav><main><p>m</main>"))[0]] == ["m"]


def test_markup_names_at_their_place():
    """A name counts as a whole attribute of the element itself, not inside other names and values."""

    def article(source):
        return [b.text for b in pages.decided(pages.blocks(source))[0]]

    for inner in (
        '<div style="overflow:hidden">kept</div>', '<a href="/hidden-gems">kept</a>', '<a href="/view?id=ad-7">kept</a>',
        '<p data-id="footer-2">kept</p>', "<p title='class=ad'>kept</p>", '<p data-role="banner">kept</p>',
        '<p aria-hidden="false">kept</p>', '<p title="a hidden id=ad">kept</p>', '<div class="has-sidebar">kept</div>',
        '<div class="no-comments text--with-form">kept</div>', '<svg viewBox="0 0 1 1"/>kept', "<svg/><p>kept</p>",
        "<a href=/hidden/ >kept</a>", '<p title="some hidden id=ad>kept</p>',
    ):
        assert article(f"<main><article>{inner}</article></main>") == ["kept"], inner
    for outer in (
        '<html class="no-ads"><body class="has-sidebar widget">{}</body></html>', '<body id="comments">{}</body>',
        '<main class="sidebar-left" id=widget>{}</main>',
    ):
        assert article(outer.format("<article>kept</article>")) == ["kept"], outer
    assert article('<article class="post has-comments related">kept</article>') == ["kept"]
    for inner in (
        "<p hidden>x</p>", '<p hidden="">x</p>', "<p data-a=1 hidden>x</p>", "<p class=ad>x</p>", '<p CLASS = "big ad">x</p>',
        "<p id='footer-2'>x</p>", '<div class="ad-no-border">x</div>', '<p role="Banner">x</p>', "<svg><text>x</text></svg>",
        "<svg a=/><text>x</text></svg>", "<span title='a'class='ad'>x</span>", "<p/class=ad>x</p>",
    ):
        assert article(f"<article>{inner}<p>kept</p></article>") == ["kept"], inner
    assert article("<article hidden>x</article><main>kept</main>") == ["kept"]


def site(n, host="h.example"):
    shared = "<div><p>Follow us on every channel and sign up for our weekly letter today</p></div>"
    end = "<p>All rights reserved by the owners of this site since the year it began</p>"
    rows = []
    for i in range(n):
        own = " ".join(f"word{i}x{k}" for k in range(30))
        rows.append((i, f"https://{host}/{i}", f"<body>{shared}<p>{own}</p><p>short {i}</p>{end}</body>", f"{own}\n\nshort {i}"))
    return rows


@pytest.mark.parametrize("block", [2000, 3])
def test_repeated_runs_of_a_host_go(spark, monkeypatch, block):
    monkeypatch.setattr(extract, "PAGES_PER_BLOCK", block)
    rows = site(12) + [(100, "https://h.example/copy", site(1)[0][2], None), (200, "http://other/", site(1)[0][2], None)]
    rows += [(300, None, None, ""), (301, "x", "", ""), (None, "https://h.example/n", "<p>only this page says it</p>", "only this page says it")]
    rows += [(400, "https://z/1", "<p>" + "long " * 200_000 + "</p>", ("long " * 200_000).strip())]
    table = spark.createDataFrame([(*r[:3], "c", 1) for r in rows], "page_id int, url string, html string, text string, n_chars int")
    got = {r["url"]: r["text"] for r in extract.main_text(table.repartition(4)).collect()}
    for _, url, source, text in rows:
        if text is not None and url != "https://h.example/0":
            assert got[url] == text, url
    # A page and its copy have no unique run, and a page alone on its host repeats nothing: all three keep everything.
    assert got["http://other/"] == got["https://h.example/0"] == got["https://h.example/copy"]
    assert got["http://other/"].startswith("Follow us") and got["http://other/"].endswith("since the year it began")
    assert extract.main_text(table.limit(0)).collect() == []


def test_common_blocks_inside_declared_pages_go(spark):
    strip = "Follow us on every channel and sign up for our weekly letter today"
    passage = "A passage of some length that just a few of the articles of this host share"

    def page(i, tag="main", host="d"):
        own = " ".join(f"word{i}x{k}" for k in range(12))
        shared = f"<p>{passage}</p>" if i < 4 else ""
        text = "\n\n".join(["Summary", own, *([passage] if i < 4 else [])])
        return (i, f"https://{host}.example/{i}", f"<{tag}><div>{strip.upper() if i == 3 else strip}</div><h2>Summary</h2><p>{own}</p>{shared}</{tag}>", text)

    rows = [page(i, "main" if i % 2 else "article") for i in range(10)]
    # Nothing but the strip; four pages of a host; one page in many rows.
    rows += [(50, "https://d.example/50", f"<main><p>{strip}</p></main>", strip)]
    rows += [(*page(i, host="few")[:3], strip.upper() + "\n\n" + page(i)[3] if i == 3 else strip + "\n\n" + page(i)[3]) for i in range(4)]
    rows += [(70, f"https://one.example/{k}", page(70)[2], strip + "\n\n" + page(70)[3]) for k in range(8)]
    table = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r["url"]: r["text"] for r in extract.main_text(table).collect()}
    assert got == {r[1]: r[3] for r in rows}


def test_suffix_ranks():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 3, 300)
    rank = extract.suffix_ranks(ids, 8)
    keys = [tuple(ids[i : i + 8]) for i in range(300)]
    assert [sorted(set(keys)).index(k) for k in keys] == (rank - 1).tolist()
