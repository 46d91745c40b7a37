"""The pipeline, stage by stage, against brute-force versions of the stages."""

import collections

import pytest

import corpus_pipeline as pipeline
from msgshield.llm import toxicity

from test_models import closure, fingerprint, plain_hits


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_stage_names_and_columns(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_toxic_rows_go(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in scores if r["predicted"] == 0}


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    prints = [fingerprint(r["text"]) for r in rows]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    first = {rows[g]["doc_id"] for g in closure(len(rows), near)}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(first)


def test_contaminated_rows_go(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    hit = {d for d, _ in plain_hits(rows, items)}
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(d for d, _ in rows if d not in hit)


def test_mix_takes_whole_documents(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    copies = collections.Counter(r["doc_id"] for r in stages[4])
    assert max(copies.values()) <= 2 and all(before[r["doc_id"]] == r for r in stages[4])
    words = sum(len(r["text"].split()) for r in stages[4])
    assert words == pytest.approx(1.5 * sum(len(r["text"].split()) for r in stages[3]), rel=0.25)


def test_every_row_of_the_mix_has_a_place(stages):
    assert collections.Counter(r["doc_id"] for r in stages[5]) == collections.Counter(r["doc_id"] for r in stages[4])
    for shard in range(24):
        slots = sorted(r["slot"] for r in stages[5] if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_run_and_empty_tables(spark, sf, stages):
    assert sorted(map(str, pipeline.run(spark, sf).collect())) == sorted(map(str, stages[5]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_stages_on_odd_rows_in_one_run(spark, sf):
    """Null and empty texts, null keys, repeated rows, a very long text and extra columns, through all stages."""
    rows = [
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
        (1, "quite another text of this id altogether", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n", None, None),
        (None, "no id here but some words", "en", None), (None, None, None, None), (7, "long words " * 60_000, "de", "b"),
        (8, "one two three four five six seven", "fr", "b"),
    ]
    docs = spark.createDataFrame(
        [(*r, len(r[1] or ""), "clash", float(i)) for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, component string, n double",
    )
    columns, counts = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        before = collections.Counter(map(str, docs.collect()))
        again = sorted(map(str, stage(spark, docs, sf).collect()))
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = collections.Counter(map(str, docs.collect()))
        assert docs.columns == columns and sorted(after.elements()) == again, name
        assert set(after) <= set(before)
        counts.append(sum(after.values()))
    assert counts[0] == len(rows)
    # One of the three equal texts, one of the four without words, and three others.
    assert counts[1] == counts[2] == 5
    placed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(placed) == counts[3]
