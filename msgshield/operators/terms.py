"""Term statistics and weights: vocabulary, TF-IDF, class weights, scaling, token attribution."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import WORD, round_exact


def words(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def with_terms(df: DataFrame, text: str, output: str = "terms", bigrams: bool = True) -> DataFrame:
    """Add the list of words and, after them, of neighbouring pairs."""
    out = df.withColumn(output, words(F.col(text)))
    if not bigrams:
        return out
    w = F.col(output)
    pairs = F.transform(
        F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")),
        lambda p: F.concat(p["a"], F.lit(" "), p["b"]),
    )
    return out.withColumn(output, F.concat(w, pairs))


def _tally(lists: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, total, df) of lists of words and, if asked for, of neighbouring words, joined by a blank."""
    codes = lists.flatten().dictionary_encode()
    words, code = codes.dictionary.cast(pa.string()), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))

    def tally(row: np.ndarray, term: np.ndarray, known: int) -> list[np.ndarray]:
        both, tf = np.unique(row * max(1, known) + term, return_counts=True)
        return [np.bincount(both % max(1, known), weights, known).astype(np.int64) for weights in (tf, None)]

    total, df = tally(row, code, len(words))
    if not pairs:
        return words, total, df
    beside = np.flatnonzero(row[1:] == row[:-1])
    pair, term = np.unique(code[beside] * max(1, len(words)) + code[beside + 1], return_inverse=True)
    a, b = (words.take(pa.array(x)) for x in np.divmod(pair, max(1, len(words))))
    more = tally(row[beside], term, len(pair))
    joined = pc.binary_join_element_wise(a, b, " ")
    return pa.concat_arrays([words, joined]), np.append(total, more[0]), np.append(df, more[1])


def _counted(df: DataFrame, terms: str, pairs: bool = False) -> DataFrame:
    """(term, total, df) of all terms; an empty term stands for the documents themselves. One pass and one shuffle by term:
    batches of documents are added up first, then map tasks, so what moves is bounded by the words in use, not by the text."""

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).drop_null()
            term, total, df = _tally(lists, pairs)
            columns = [pa.concat_arrays([term, pa.array([""])]), pa.array(np.append(total, 0)), pa.array(np.append(df, len(lists)))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "total", "df"])

    rows = df.select(terms).mapInArrow(tallies, "term string, total long, df long")
    return rows.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def vocabulary(df: DataFrame, terms: str = "terms", size: int = 10_000) -> DataFrame:
    """The ``size`` most frequent terms of the corpus, ties by term, with total and document frequency."""
    return _counted(df, terms).filter(F.col("term") != "").orderBy(F.desc("total"), "term").limit(size)


def fit_vocabulary(
    df: DataFrame, terms: str = "terms", size: int = 10_000, pairs: bool = False
) -> tuple[int, list[str], list[float]]:
    """(documents, terms, ln((1 + n) / (1 + df)) + 1 of each): one pass; ``size`` + 1 rows reach the driver.

    With ``pairs``, ``terms`` are the words, and neighbouring ones count as terms too."""
    top = _counted(df, terms, pairs).orderBy(F.col("term") != "", F.desc("total"), "term").limit(size + 1).collect()
    if not top:
        return 0, [], []
    rows = top[0]["df"]
    return rows, [r["term"] for r in top[1:]], [log((1.0 + rows) / (1.0 + r["df"])) + 1.0 for r in top[1:]]


def tfidf(
    df: DataFrame, doc: str, text: str, size: int = 10_000, sublinear: bool = False, bigrams: bool = True
) -> DataFrame:
    """Long table (doc, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length per document.

    ``sublinear`` replaces tf by 1 + ln tf. Counts, weights and length of a document need its own row only, so after the
    vocabulary, which ``size`` bounds, nothing is shuffled.
    """
    rows = with_terms(df.select(doc, text), text, "__terms", bigrams).select(doc, "__terms")
    _, names, weights = fit_vocabulary(rows, "__terms", size)
    schema = T.StructType([rows.schema[0], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = pa.array(names, pa.string()), np.array(weights)
        for batch in batches:
            lists = batch.column(1)
            term = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            found = term.is_valid().to_numpy(zero_copy_only=False)
            pair, tf = np.unique(
                row[found] * len(idf) + term.drop_null().to_numpy(), return_counts=True
            )
            row, term = pair // max(1, len(idf)), pair % max(1, len(idf))
            weight = (np.log(tf) + 1.0 if sublinear else tf.astype(float)) * idf[term]
            norm = np.sqrt(np.bincount(row, weight * weight, len(lists)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), known.take(pa.array(term)), pa.array(weight / norm[row])], names=schema.names
            )

    return rows.mapInArrow(weigh, schema)


def token_attribution(
    weights: DataFrame, coefficients: DataFrame, doc: str, top: int = 5, floor: float = 0.0001
) -> DataFrame:
    """The ``top`` single words per document by coefficient * weight; only values above ``floor``.

    ``weights`` is (doc, term, weight), ``coefficients`` (term, coefficient) of a linear model: broadcast, as it is no
    larger than the model's vocabulary. The per-document limit is applied in the map tasks.
    """
    scored = weights.filter(~F.contains("term", F.lit(" "))).join(F.broadcast(coefficients), "term")
    scored = scored.withColumn("importance", F.col("weight") * F.col("coefficient"))
    scored = scored.filter(F.col("importance") > floor)
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("importance"), "term"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select(doc, "rank", F.col("term").alias("word"), round_exact(F.col("importance"), 4).alias("importance"))


def class_weights(df: DataFrame, label: str = "label", inverse: bool = False) -> DataFrame:
    """Weight per class: n / (2 n_c), or 1 / n_c scaled to sum 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    if inverse:
        weight = (1.0 / F.col("rows")) / F.sum(1.0 / F.col("rows")).over(everything)
    else:
        weight = F.sum("rows").over(everything) / (F.col("rows") * 2.0)
    return counts.withColumn("weight", weight)


def with_class_weight(df: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    """Add the balanced class weight of a binary label to every row."""
    weights = class_weights(df.filter(F.col(label).isin(0, 1)), label).select(label, F.col("weight").alias(output))
    # Two rows at most: the label is binary.
    return df.join(F.broadcast(weights), label, "left")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population standard deviation of every column; a constant column gets deviation 1."""
    aggs = []
    for c in columns:
        deviation = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(deviation > 0, deviation).otherwise(1.0).alias(f"{c}__std")]
    return df.agg(*aggs)


def standardize(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / deviation with the statistics of ``fit_on`` (the training rows)."""
    stats = moments(fit_on, columns).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(stats[f"{c}__mean"])) / F.lit(stats[f"{c}__std"]) for c in columns}
    )
