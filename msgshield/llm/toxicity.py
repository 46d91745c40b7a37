"""Toxicity by class-conditional Kneser-Ney models of the bytes of words, one of toxic and one of ordinary texts.

Each class predicts the next byte of a word from up to six before it and backs off to continuation counts that both
classes share, so an expression that is rare in both is about as likely in both, and a spelling never seen is judged
by its parts. A word's evidence is the difference of its two log-likelihoods. A text's evidence is normalised by
length: the mean over the whole text, and over the stretches of words where it is greatest. A logistic curve over
these, fitted on labelled texts that gave no counts, makes it a score from 0 to 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import StoredBytes
from .words import Words, hashes, rows_of, slices, split

# Labelled rows that a model is fitted on, at most so many of each class; chosen by a hash of doc_id.
LABELLED_ROWS = 4000
# One in so many of them gives no counts but fits the curve.
CURVE_SHARE = 4
# Bytes of a gram: the byte and up to six before it, the start of the word included.
TOP = 7
DISCOUNT = 0.75
CLASS_DISCOUNT = 3.0
EDGE = 32
# Different words whose grams are worked out together.
WORDS_AT_ONCE = 1 << 15
# Words in a stretch.
STRETCHES = (1, 4, 16)
SLICE_BYTES = 1 << 22


def grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, size, word): for every byte of the chosen words and their end, the last ``TOP`` bytes from the start mark
    on as one number, how many there are, and the place of the word in ``chosen``."""
    start, length = words.start[chosen], words.end[chosen] - words.start[chosen]
    size = length + 2
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]) if len(ends) else 0, EDGE, dtype=np.uint64)
    word = np.repeat(np.arange(len(chosen)), size)
    at = np.arange(len(text)) - (ends - size)[word]
    body = (at > 0) & (at <= length[word])
    text[body] = words.data[(start[word] + at - 1)[body]]
    gram = text.copy()
    for back in range(1, TOP):
        gram[back:] |= np.where(at[back:] >= back, text[:-back] << np.uint64(8 * back), np.uint64(0))
    real = at > 0
    return gram[real], np.minimum(at[real] + 1, TOP), word[real]


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


@dataclass
class Order:
    """Seen grams of one size with their probability, and seen histories with the share left to shorter ones."""

    grams: np.ndarray
    probability: np.ndarray
    histories: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    shared: list[Order] = field(default_factory=list)
    grams: np.ndarray | None = None
    kept: np.ndarray | None = None
    histories: np.ndarray | None = None
    left: np.ndarray | None = None
    words: np.ndarray | None = None
    word_evidence: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    curve: np.ndarray | None = None


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table; ``len(table)`` for those that are not there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table))


def _shared_probability(model: Model, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probability of the last byte by the counts of both classes, from the longest history shorter than the gram's."""
    p = np.full(len(gram), 1 / 256)
    for length, order in enumerate(model.shared, 1):
        rows = slice(None) if length == 1 else np.flatnonzero(size > length)
        g = gram[rows] & _mask(length)
        at, head = _find(order.grams, g), _find(order.histories, g >> np.uint64(8))
        left = np.append(order.left, 1.0)[head] * p[rows]
        p[rows] = np.where(at < len(order.grams), np.append(order.probability, 0.0)[at], left)
    return p


def distinct_words(texts: pa.Array, toxic: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, hashes, counts): the different words of the texts in order of their hash, with their counts in toxic and
    ordinary texts. The texts are gone through slice by slice."""
    ids, counts, lengths, data = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for at, piece in slices(texts, SLICE_BYTES):
        words = split(piece)
        side = 1 - toxic[at : at + len(piece)][rows_of(words.first)]  # 0: toxic, 1: ordinary
        known, first, inverse = np.unique(hashes(words), return_index=True, return_inverse=True)
        length = words.end[first] - words.start[first]
        begin = np.repeat(words.start[first] - (np.cumsum(length) - length), length)
        ids.append(known)
        counts.append(np.stack([np.bincount(inverse[side == c], minlength=len(known)) for c in (0, 1)], axis=1))
        lengths.append(length)
        data.append(words.data[begin + np.arange(len(begin))])
    known, first, inverse = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
    each = np.concatenate(counts)
    total = np.stack([np.bincount(inverse, each[:, c], len(known)) for c in (0, 1)], axis=1)
    length = np.concatenate(lengths)
    start = np.cumsum(length) - length
    return Words(np.concatenate(data), start[first], (start + length)[first], np.array([0, len(known)])), known, total


def fit_counts(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The two models of the texts; ``toxic`` holds 0 and 1. The curve is left open."""
    words, known, counts = distinct_words(texts, toxic)
    # Different grams with their counts, from some words at a time.
    seen, size, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for at in range(0, len(known), WORDS_AT_ONCE):
        chosen = np.arange(at, min(at + WORDS_AT_ONCE, len(known)))
        gram, sizes, word = grams(words, chosen)
        gram, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        seen.append(gram)
        size.append(sizes[first])
        total.append(np.stack([np.bincount(inverse, counts[at + word, c], len(gram)) for c in (0, 1)], axis=1))
    model = Model()
    model.grams, first, inverse = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
    sizes, each = np.concatenate(size)[first], np.concatenate(total)
    for length in range(1, TOP):
        longer = np.unique(model.grams[sizes > length] & _mask(length + 1))
        shorter, kinds = np.unique(longer & _mask(length), return_counts=True)
        heads, head = np.unique(shorter >> np.uint64(8), return_inverse=True)
        all_kinds, kept = np.bincount(head, kinds, len(heads)), kinds - DISCOUNT
        left = np.bincount(head, minlength=len(heads)) * DISCOUNT / np.maximum(all_kinds, 1)
        below = _shared_probability(model, shorter, np.full(len(shorter), length))
        probability = kept / np.maximum(all_kinds, 1)[head] + left[head] * below
        model.shared.append(Order(shorter, probability, heads, left))
    model.histories, head = np.unique(model.grams >> np.uint64(8), return_inverse=True)
    kept, left = [], []
    for c in (0, 1):
        n = np.bincount(inverse, each[:, c], len(model.grams))
        cut = np.minimum(n, CLASS_DISCOUNT)
        of_head = np.bincount(head, n, len(model.histories))
        kept.append((n - cut) / np.maximum(of_head, 1)[head])
        left.append(np.where(of_head > 0, np.bincount(head, cut, len(model.histories)) / np.maximum(of_head, 1), 1.0))
    model.kept = np.vstack([np.stack(kept, axis=1), np.zeros((1, 2))]).astype(np.float32)
    model.left = np.vstack([np.stack(left, axis=1), np.ones((1, 2))]).astype(np.float32)
    model.word_evidence = word_evidence(model, words, np.arange(len(known))).astype(np.float32)
    model.words = known
    return model


def word_evidence(model: Model, words: Words, chosen: np.ndarray) -> np.ndarray:
    """Toxic minus ordinary log-likelihood of the chosen words."""
    out = [np.zeros(0)]
    for at in range(0, len(chosen), WORDS_AT_ONCE):
        some = chosen[at : at + WORDS_AT_ONCE]
        gram, size, word = grams(words, some)
        gram, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        shared = _shared_probability(model, gram, size[first])[:, None]
        p = model.kept[_find(model.grams, gram)] + model.left[_find(model.histories, gram >> np.uint64(8))] * shared
        out.append(np.bincount(word, (np.log(p[:, 0]) - np.log(p[:, 1]))[inverse], len(some)))
    return np.concatenate(out)


def evidence(model: Model, words: Words) -> np.ndarray:
    """The evidence of every word; words that the model was not fitted on are worked out once each."""
    ids = hashes(words)
    at = _find(model.words, ids)
    values = np.append(model.word_evidence, 0.0).astype(float)[at]
    new = np.flatnonzero(at == len(model.words))
    _, first, inverse = np.unique(ids[new], return_index=True, return_inverse=True)
    if len(new):
        values[new] = word_evidence(model, words, new[first])[inverse]
    return values


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean evidence of each text and the greatest means of its stretches; zeros for a text without words."""
    words = split(texts)
    n = len(words.first) - 1
    out = np.zeros((n, 1 + len(STRETCHES)))
    if not len(words.start):
        return out
    values = evidence(model, words)
    length = np.diff(words.first)
    some = np.flatnonzero(length)
    first = words.first[:-1][some]
    sums = np.concatenate([[0.0], np.cumsum(values)])
    out[some, 0] = (sums[words.first[1:][some]] - sums[first]) / length[some]
    end = np.repeat(words.first[1:][some], length[some])
    for k, stretch in enumerate(STRETCHES):
        # A stretch at the end of a text is cut off there but still divided by the full length.
        stop = np.minimum(np.arange(len(values)) + stretch, end)
        out[some, 1 + k] = np.maximum.reduceat((sums[stop] - sums[:-1]) / stretch, first)
    return out


def fit_curve(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, ...]:
    """(centre, scale, coefficients) of a weighted logistic curve, by Newton steps; the intercept comes last."""
    centre, scale = values.mean(axis=0), values.std(axis=0) + 1e-9
    x = np.hstack([(values - centre) / scale, np.ones((len(values), 1))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - penalty * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


def fit_rows(texts: pa.Array, toxic: np.ndarray, totals: tuple[int, int], curve_share: int = CURVE_SHARE) -> Model | None:
    """A model of labelled texts in a fixed order; ``totals`` are the labelled rows of class 0 and 1 that they stand for.

    None if a class has no text with words to count.
    """
    order = np.arange(len(toxic))
    curve = order % curve_share == curve_share - 1
    if not all(((toxic == c) & ~curve).any() for c in (0, 1)):
        return None
    model = fit_counts(texts.filter(pa.array(~curve)), toxic[~curve])
    # Too few rows for a curve of their own: the counted ones fit it.
    rows = curve if all(((toxic == c) & curve).sum() >= 2 for c in (0, 1)) else np.ones(len(toxic), dtype=bool)
    weight = np.array([totals[c] / max(1, ((toxic == c) & rows).sum()) for c in (0, 1)])[toxic[rows]]
    values = np.concatenate([features(model, piece) for _, piece in slices(texts.filter(pa.array(rows)), SLICE_BYTES)])
    model.centre, model.scale, model.curve = fit_curve(values, toxic[rows], weight)
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Score of each text, between 0 and 1."""
    x = (features(model, texts) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.curve[:-1] + model.curve[-1], -500, 500)))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def unpacked(data: bytes) -> Model:
    """A model from the form in which it travels."""
    fields = pickle.loads(data)
    return Model(**(fields | {"shared": [Order(**order) for order in fields["shared"]]}))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> StoredBytes | None:
    """The packed model, as a stored table, of the labelled documents whose fold is not 0: at most ``rows`` of each class, the first by hash.

    A document labelled twice is toxic if a label says so; labels other than 0 and 1, or without a document, do not
    count. None without documents of both classes.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    totals = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None
    place = F.xxhash64(F.lit("labelled"), "doc_id")
    chosen = known.filter("__toxic = 0").orderBy(place, "doc_id").limit(rows)
    chosen = chosen.unionByName(known.filter("__toxic = 1").orderBy(place, "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))
    # One task of bounded size fits the model, so that the sample does not pass the driver.
    order = F.xxhash64(F.lit("curve"), "doc_id")
    sample = texts.repartition(1).sortWithinPartitions("__toxic", order, "doc_id").select("__toxic", F.coalesce("text", F.lit("")))

    def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        given = pa.Table.from_batches(rows) if rows else None
        if given is not None and given.num_rows:
            column = given.column(1).combine_chunks()
            model = fit_rows(column, given.column(0).to_numpy().astype(int), (totals[0], totals[1]))
            if model is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(asdict(model))], pa.binary())], ["model"])

    model = StoredBytes(sample.mapInArrow(fit_batches, "model binary"), "toxicity-model")
    return None if model.empty() else model


def scored(docs: DataFrame, labels: DataFrame, *carry: Column) -> DataFrame:
    """The columns ``carry`` and ``__score`` of every row of ``docs``; only text goes into a score.

    Null and empty texts have the score of no evidence. Without labelled documents of both classes every score is 0.
    """
    model = fit(docs, labels)
    rows = docs.select(*carry, F.col("text").alias("__text"))
    if model is None:
        return rows.drop("__text").withColumn("__score", F.lit(0.0))
    schema = StructType([*rows.schema.fields[:-1], StructField("__score", DoubleType())])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = unpacked(model.load())
        for batch in batches:
            parts = [scores(tables, piece) for _, piece in slices(batch.column(batch.num_columns - 1), SLICE_BYTES)]
            values = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=schema.names)

    return rows.mapInArrow(batches_of, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held = (fold(F.col("doc_id")) == 0).alias("held_out")
    out = scored(docs, labels, F.col("doc_id"), held)
    out = out.withColumnRenamed("__score", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more.

    Null and empty texts have no evidence and stay; rows with equal texts stay or go together. Other columns are kept as they are.
    """
    columns = [F.col(c) for c in docs.columns]
    return scored(docs, labels, *columns).filter("__score < 0.5").select(*docs.columns)
