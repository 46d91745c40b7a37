"""The registered queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed, extract, licences, maxent, merkle, mixing, packing, resample, shards, simhash, sql, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable:
    """Register a query and, if there is one, its SQL."""

    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


@register("op1_maxent_scores")
def op1_maxent_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probability of every document by the maximum-entropy model and by the add-half unigram model."""
    return maxent.language_scores(table(spark, sf, "documents"))


@register("op2_bm25_decontamination")
def op2_bm25_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with passages that hold a test item."""
    return decontam.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), F.col("doc_id"), whole=True)


@register("op3_chat_collapse", sql.CHAT)
def op3_chat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse_and_render(table(spark, sf, "conversations"))


@register("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of the vectors of one label."""
    return embed.near_vectors(table(spark, sf, "embeddings"))


@register("op5_hash_tree_shards", sql.shard_sql())
def op5_hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents on 24 shards, and on 25."""
    return shards.shard_documents(table(spark, sf, "documents"))


@register("op6_systematic_mix", sql.MIX)
def op6_systematic_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = mixing.mix(table(spark, sf, "documents"), carry=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op7_suffix_array_extraction")
def op7_suffix_array_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extract.main_text(table(spark, sf, "pages"))


@register("op8_licence_scan", licences.ORACLE)
def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Own and inherited licence of every document as a file."""
    return licences.scan_files(licences.document_files(table(spark, sf, "documents")))


@register("op9_kneser_ney_toxicity")
def op9_kneser_ney_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op10_pivot_simhash")
def op10_pivot_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@register("op11_importance_resampling", sql.RESAMPLE)
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op12_merkle_manifest", sql.manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and checked proof of every document."""
    return merkle.manifest(table(spark, sf, "documents"))


@register("op13_retrieval_packing")
def op13_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every piece of a document in the packed sequences."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
