"""URL jobs: unified corpus and domain-disjoint splits, from files to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import root_domain, with_canonical_url
from ..operators.dedup import keep_first
from ..operators.filters import filter_computed
from ..operators.joins import assert_no_leak
from ..operators.ordering import rank_cutoffs, shuffle_key
from ..operators.splits import SEED, balanced_sample, unseen_keys
from ..session import stored
from ..sources.readers import capped_scan, read_qr_payloads, read_url_csv
from ..sources.writers import write_csv

CORPUS_COLUMNS = ["raw_url", "normalized_url", "domain", "root_domain", "label", "source"]
LONG_URL = 35
# Rows of each class in the sample of long URLs.
TEMPORAL_ROWS = 250
SPLIT_FILES = ["train", "validation", "test_random", "test_unseen_domain", "test_qr_unseen"]


def url_corpus(rows: DataFrame, n_per_class: int | None = None) -> DataFrame:
    """Distinct canonical URLs of all sources (raw_url, label, source, ordinal).

    Of equal URLs the first survives: labelled sources before QR payloads, benign before malicious, then input order.
    Ordinals lie between 0 and 2 ** 60 and are unique per kind of source and label. All rows are read unless a number
    of rows per source and label is given. The canonical rows are stored, as both steps of the deduplication read them.
    """
    if n_per_class is not None:
        rows = capped_scan(rows, n_per_class)
    rows = filter_computed(with_canonical_url(rows, "raw_url"), F.col("normalized_url") != "")
    rank = F.shiftleft((F.col("source") == "qr_decoded").cast("long") * 2 + F.col("label"), 60) + F.col("ordinal")
    rows = rows.withColumn("__order", rank).select("raw_url", "normalized_url", "domain", "label", "source", "__order")
    first = keep_first(stored(rows, "canonical"), "normalized_url", "__order")
    return first.withColumn("root_domain", root_domain(F.col("domain"))).select(*CORPUS_COLUMNS)


def url_splits(corpus: DataFrame, seed: int = SEED) -> DataFrame:
    """Corpus with ``split``.

    15 % of the root domains form ``test_unseen_domain``. Of the rest, 25 % of the QR rows form ``test_qr_unseen``,
    then 15 % ``test_random``, then 15 % ``validation``, each per label. The cut-offs are found one after the other in a
    stored narrow table of hashes, label and source; the corpus is read twice: for that table, and to be placed.
    """
    seeds = {"__h0": seed, "__h1": seed + 1, "__h2": seed + 2}
    narrow = corpus.select(
        "label", (F.col("source") == "qr_decoded").alias("__from_qr"), shuffle_key(seed, F.col("root_domain")).alias("__domain"),
        *[shuffle_key(s, F.col("normalized_url")).alias(h) for h, s in seeds.items()],
    )
    narrow = stored(narrow, "split-hashes")
    limit = unseen_keys(narrow, "__domain", 0.15)
    pools = [
        (lambda: ~F.col("__unseen") & F.col("__from_qr"), "__h0", 0.25, "__qr"),
        (lambda: ~F.col("__unseen") & ~F.col("__qr"), "__h1", 0.15, "__random"),
        (lambda: ~F.col("__unseen") & ~F.col("__qr") & ~F.col("__random"), "__h2", 0.15, "__validation"),
    ]

    def marked(rows: DataFrame) -> DataFrame:
        unseen = F.col("__domain") <= F.lit(limit) if limit is not None else F.lit(False)
        return rows.withColumn("__unseen", unseen)

    narrow, cuts = marked(narrow), []
    for pool, order, fraction, name in pools:
        cut = rank_cutoffs(
            narrow.filter(pool()), ["label"], order, {f"{name}_cut": lambda n, f=fraction: F.floor(n.cast("double") * F.lit(f))}
        )
        # At most one row a label: the cut-off is found once and is a constant from here on.
        found = cut.collect()
        cuts.append({r["label"]: r[f"{name}_cut"] for r in found})
        narrow = narrow.withColumn(name, _within(pool(), order, cuts[-1]))
    rows = corpus.withColumn("__from_qr", F.col("source") == "qr_decoded")
    rows = rows.withColumn("__domain", shuffle_key(seed, F.col("root_domain")))
    rows = marked(rows.withColumns({h: shuffle_key(s, F.col("normalized_url")) for h, s in seeds.items()}))
    for (pool, order, _, name), cut in zip(pools, cuts, strict=True):
        rows = rows.withColumn(name, _within(pool(), order, cut))
    split = (
        F.when(F.col("__unseen"), "test_unseen_domain")
        .when(F.col("__qr"), "test_qr_unseen")
        .when(F.col("__random"), "test_random")
        .when(F.col("__validation"), "validation")
        .otherwise("train")
    )
    return rows.withColumn("split", split).select(*corpus.columns, "split")


def _within(pool: Column, order: str, cuts: dict) -> Column:
    """Whether a row of the pool lies below the cut-off of its label."""
    inside = F.lit(False)
    for label, cut in cuts.items():
        if cut is not None:
            inside = inside | ((F.col("label") == F.lit(label)) & (F.col(order) <= F.lit(cut)))
    return F.coalesce(pool & inside, F.lit(False))


def temporal_sample(splits: DataFrame, cap: int | None, seed: int = SEED) -> DataFrame:
    """Balanced sample of the long URLs of ``test_random``, at most ``cap`` of each class; it is part of that set, not
    disjoint from it."""
    long = splits.filter((F.col("split") == "test_random") & (F.length("normalized_url") > LONG_URL))
    return balanced_sample(long, "normalized_url", cap, seed=seed)


def assert_unseen_domains(splits: DataFrame) -> None:
    """Raise if a root domain of ``test_unseen_domain`` occurs in another split."""
    unseen = F.col("split") == "test_unseen_domain"
    assert_no_leak(splits.filter(~unseen), splits.filter(unseen), "root_domain")


def build_url_splits(
    spark: SparkSession, labelled: str, payloads: dict[str, int], out: str, n_per_class: int | None = None
) -> DataFrame:
    """From CSV files to CSV files: a labelled URL table and QR tables (path -> label) become one corpus and six files.

    ``out`` gets one folder for each split and one for the sample of long URLs. Nothing is written if a root domain of
    the unseen test set occurs elsewhere. Returns the stored splits.
    """
    rows = read_url_csv(spark, labelled)
    for path, label in payloads.items():
        rows = rows.unionByName(read_qr_payloads(spark, path, label))
    corpus = stored(url_corpus(rows, n_per_class), "corpus")
    splits = stored(url_splits(corpus), "splits")
    assert_unseen_domains(splits)
    for name in SPLIT_FILES:
        write_csv(splits.filter(F.col("split") == name).select(CORPUS_COLUMNS), f"{out}/{name}")
    write_csv(temporal_sample(splits, TEMPORAL_ROWS).select(CORPUS_COLUMNS), f"{out}/test_temporal")
    return splits


def test_suites(splits: DataFrame) -> DataFrame:
    """Rows of the four test suites with ``suite``; the temporal rows occur twice."""
    named = splits.filter(F.col("split").startswith("test_")).withColumn("suite", F.col("split"))
    return named.unionByName(temporal_sample(splits, TEMPORAL_ROWS).withColumn("suite", F.lit("test_temporal")))
