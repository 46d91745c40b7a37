"""A hashed maximum-entropy language model with a class-factored softmax, trained by distributed gradient updates.

P(word | history) = P(class | history) * P(word | class, history). The 512 most frequent words lie in eight classes of
64 by rank, all other words in 24 classes by a hash of their last two bytes. The class softmax has a row of weights for each feature:
the word before, the word before that (a skip), the one before (a skip), and the hashed pair of the two before. Within
a frequent class a second softmax has hashed rows for (class, word before) and (class, word before that). Within a
tail class a word has the add-half share of its own training count, so every word of the corpus is counted, and one
slot a class stands for all unseen words. Both softmaxes start from training frequencies; the features correct them.

Training goes in rounds. In each, every task makes gradient updates over its part of the round's documents, starting
from the common weights; a row's new weights are the average of the tasks' changes, weighted by how often they met the
row. All training documents take part, each in one round. Only the weights, whose size is fixed, and a fixed number of
frequent words pass the driver; the counts of all words stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, stored
from .words import hashes, mixed, rows_of, slices, split

HELD_FOLD = 1
END = np.uint64(0xE4D0F7E47E0D5EED)
HEAD_CLASSES, HEAD_WORDS = 8, 64
TAIL_CLASSES = 24
CLASSES = HEAD_CLASSES + TAIL_CLASSES
# Words whose counts the scoring tasks hold; the others are joined.
FREQUENT = 1 << 16
# Words that are features of their own; the others are represented by their tail class.
CONTEXT_WORDS = 2048
CONTEXTS = CONTEXT_WORDS + TAIL_CLASSES + 1
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 13
BLOCK = 256
ROUNDS = 3
BATCH = 8192
RATE = 0.25
SLICE_BYTES = 1 << 21
# Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 20
LN10 = float(np.log(10))


@dataclass
class Stream:
    """Tokens of a slice of texts, each text closed by an end token."""

    ids: np.ndarray
    tail: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Stream:
    """Word hashes with the end tokens put in, and each token's tail class (0 for ends)."""
    words = split(texts)
    n = len(words.first) - 1
    last = words.data[words.end - 1].astype(np.uint64) if len(words.end) else np.zeros(0, np.uint64)
    second = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0) if len(words.end) else last
    tail = (mixed(last * np.uint64(256) + second.astype(np.uint64)) % np.uint64(TAIL_CLASSES)).astype(np.int64)
    at = words.first[1:]
    return Stream(
        np.insert(hashes(words), at, END), np.insert(tail, at, 0), words.first + np.arange(n + 1)
    )


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is 1 modulo 5; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == HELD_FOLD


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        ids, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        n = np.bincount(inverse, n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(tail[first]), pa.array(n)], ["h", "tail", "n"])

    for batch in batches:
        for _, piece in slices(batch.column(0), SLICE_BYTES):
            stream = tokens(piece)
            ids, first, n = np.unique(stream.ids, return_index=True, return_counts=True)
            held.append((ids, stream.tail[first], n))
            if sum(len(x[0]) for x in held) >= HELD_WORDS:
                yield merged()
                held.clear()
    if held:
        yield merged()


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, tail, n): the training count of every word, from a column of texts."""
    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count_batches, "h long, tail long, n long")
    return counted.groupBy("h", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frequent words in order of their hash with rank and count, and the weights."""

    ids: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray


def start(counts: DataFrame) -> Model:
    """The model before training: frequencies only."""
    by_tail = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    frequent = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    ids = frequent["h"].to_numpy().view(np.uint64)
    count, tail = frequent["n"].to_numpy(), frequent["tail"].to_numpy()
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in by_tail:
        tail_n[row["tail"]], tail_v[row["tail"]] = row["n"], row["v"]
    total, distinct = int(tail_n.sum()), int(tail_v.sum())
    head = HEAD_CLASSES * HEAD_WORDS
    tail_n -= np.bincount(tail[:head], count[:head], TAIL_CLASSES)
    tail_v -= np.bincount(tail[:head], minlength=TAIL_CLASSES)
    words = np.zeros(head)
    words[: len(count[:head])] = count[:head]
    words = words.reshape(HEAD_CLASSES, HEAD_WORDS)
    tail_total = tail_n + 0.5 * (tail_v + 1)
    with np.errstate(divide="ignore"):
        class_bias = np.log(np.concatenate([words.sum(axis=1), tail_total]))
        word_bias = np.log(words)
    order = np.argsort(ids)
    return Model(
        ids[order], order, count[order], total, distinct, tail_total,
        np.maximum(class_bias, -1e4).astype(np.float32), np.maximum(word_bias, -1e4).astype(np.float32),
        np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, HEAD_WORDS), np.float32),
    )


@dataclass
class Examples:
    """What the softmaxes see of a stream: target classes and words, and rows of weights."""

    target: np.ndarray
    word: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray
    known: np.ndarray
    count: np.ndarray


def examples(model: Model, stream: Stream) -> Examples:
    """Targets and features of every token; ``word`` is -1 outside the frequent classes."""
    n = len(stream.ids)
    rank, count, known = np.full(n, FREQUENT), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    if len(model.ids):
        at = np.searchsorted(model.ids, stream.ids)
        at[at == len(model.ids)] = 0
        known = model.ids[at] == stream.ids
        rank[known], count[known] = model.rank[at[known]], model.count[at[known]]
    head = rank < HEAD_CLASSES * HEAD_WORDS
    target = np.where(head, rank // HEAD_WORDS, HEAD_CLASSES + stream.tail)
    context = np.where(rank < CONTEXT_WORDS, rank, CONTEXT_WORDS + stream.tail)
    place = np.arange(n) - stream.first[:-1][rows_of(stream.first)]
    before = []
    for back in (1, 2, 3):
        c = np.full(n, CONTEXTS - 1)
        c[back:] = context[:-back] if n > back else context[:0]
        before.append(np.where(place >= back, c, CONTEXTS - 1))
    pair = mixed(before[0].astype(np.uint64) * np.uint64(CONTEXTS) + before[1].astype(np.uint64))
    hashed = 3 * CONTEXTS + (pair % np.uint64(CLASS_ROWS - 3 * CONTEXTS)).astype(np.int64)
    class_rows = np.stack([before[0], CONTEXTS + before[1], 2 * CONTEXTS + before[2], hashed])
    inner = [
        mixed((np.uint64(2) * target.astype(np.uint64) + np.uint64(k)) * np.uint64(CONTEXTS) + before[k].astype(np.uint64))
        for k in (0, 1)
    ]
    word_rows = np.stack([(x % np.uint64(WORD_ROWS)).astype(np.int64) for x in inner])
    return Examples(target, np.where(head, rank % HEAD_WORDS, -1), class_rows, word_rows, known, count)


def _log_softmax(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probabilities of bias plus the sum of the examples' rows."""
    x = bias + table[rows[0]]
    for r in rows[1:]:
        x += table[r]
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_probability(model: Model, e: Examples) -> np.ndarray:
    """Natural log-probability of every token, but for words outside the frequent ones without their log(count + 1/2)."""
    out = np.empty(len(e.target))
    for at in range(0, len(out), BATCH):
        s = slice(at, at + BATCH)
        target, word = e.target[s], e.word[s]
        each = np.arange(len(target))
        p = _log_softmax(model.class_bias, model.class_rows, e.class_rows[:, s])[each, target].astype(np.float64)
        head = np.flatnonzero(word >= 0)
        inner = _log_softmax(model.word_bias[target[head]], model.word_rows, e.word_rows[:, s][:, head])
        p[head] += inner[np.arange(len(head)), word[head]]
        rest = word < 0
        p[rest] += np.where(e.known[s][rest], np.log(e.count[s][rest] + 0.5), 0.0)
        p[rest] -= np.log(model.tail_total[target[rest] - HEAD_CLASSES])
        out[s] = p
    return out


class Trainer:
    """Gradient updates of one table of weights: AdaGrad with one step size a row."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.seen = np.zeros(len(table), dtype=np.float32)
        self.size = np.full(len(table), 1.0, dtype=np.float32)

    def update(self, rows: np.ndarray, slope: np.ndarray) -> None:
        """Add the slopes (one of each example) to all rows of the examples."""
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        total = np.add.reduceat(slope[order % rows.shape[1]], first, axis=0)
        at = flat[first]
        self.seen[at] += np.diff(np.append(first, len(flat)))
        self.size[at] += np.square(total).sum(axis=1)
        self.table[at] += RATE * total / np.sqrt(self.size[at])[:, None] * np.sqrt(np.float32(self.table.shape[1] / 8))


def train(model: Model, trainers: tuple[Trainer, Trainer], e: Examples) -> None:
    """One pass of updates over the examples."""
    for at in range(0, len(e.target), BATCH):
        s = slice(at, at + BATCH)
        target, word = e.target[s], e.word[s]
        slope = -np.exp(_log_softmax(model.class_bias, trainers[0].table, e.class_rows[:, s]))
        slope[np.arange(len(target)), target] += 1
        trainers[0].update(e.class_rows[:, s], slope)
        head = np.flatnonzero(word >= 0)
        if len(head):
            rows = e.word_rows[:, s][:, head]
            slope = -np.exp(_log_softmax(model.word_bias[target[head]], trainers[1].table, rows))
            slope[np.arange(len(head)), word[head]] += 1
            trainers[1].update(rows, slope)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Sum of the weighted changes and of the weights of one block of rows."""
    seen = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["seen"])
    change = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["change"])
    row = (int(group["block"].iloc[0]), int(group["part"].iloc[0]), seen.astype(np.float32).tobytes(), change.astype(np.float32).tobytes())
    return pd.DataFrame([row], columns=["block", "part", "seen", "change"])


CHANGES = "block int, part int, seen binary, change binary"


def one_round(model: Model, texts: DataFrame) -> None:
    """Train on a round's texts and move the model's weights to the average."""
    shared = Shared(texts.sparkSession, model)
    # Two steps of merging, each of about the square root of the number of tasks.
    parts = max(1, int(np.sqrt(texts.rdd.getNumPartitions())))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: Model = shared.load()
        trainers = Trainer(common.class_rows.copy()), Trainer(common.word_rows.copy())
        some = False
        for batch in batches:
            for _, piece in slices(batch.column(0), SLICE_BYTES):
                train(common, trainers, examples(common, tokens(piece)))
                some = True
        if not some:
            return
        part = TaskContext.get().partitionId() % parts
        rows = []
        for k, (trainer, table) in enumerate(zip(trainers, (common.class_rows, common.word_rows), strict=True)):
            change = (trainer.table - table) * trainer.seen[:, None]
            for block in range(len(table) // BLOCK):
                s = slice(block * BLOCK, (block + 1) * BLOCK)
                rows.append((k * CLASS_ROWS // BLOCK + block, part, trainer.seen[s].tobytes(), change[s].tobytes()))
        columns = zip(*rows, strict=True)
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "part", "seen", "change"])

    changes = texts.mapInArrow(local, CHANGES)
    merged = changes.groupBy("block", "part").applyInPandas(_merge, CHANGES)
    merged = merged.groupBy("block").applyInPandas(_merge, CHANGES).toArrow().to_pylist()
    for row in merged:
        seen = np.maximum(np.frombuffer(row["seen"], np.float32), 1)[:, None]
        change = np.frombuffer(row["change"], np.float32).reshape(BLOCK, -1) / seen
        k, block = divmod(row["block"], CLASS_ROWS // BLOCK)
        table = (model.class_rows, model.word_rows)[k]
        table[block * BLOCK : (block + 1) * BLOCK] += change
    shared.data.unpersist()


def fit(training: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The trained model: every document of ``training`` takes part in one round, dealt by a hash."""
    model = start(counts)
    texts = training.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in range(rounds if model.total else 0):
        chosen = F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == k
        one_round(model, texts.filter(chosen).select("text"))
    return model


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document with the sums over frequent words, and its other words for the join with their counts.

    ``uid`` tells rows apart that repeat a doc_id. ``base`` lacks the denominators.
    """
    shared = Shared(docs.sparkSession, model)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.load()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, piece in slices(batch.column(2), SLICE_BYTES):
                stream = tokens(piece)
                e = examples(model, stream)
                p = log_probability(model, e) / LN10
                n, row = len(piece), rows_of(stream.first)
                known = e.known
                base = np.bincount(row[known], np.log10(e.count[known] + 0.5), n).astype(np.float64)
                rare = np.flatnonzero(~known)
                offsets = np.searchsorted(rare, stream.first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(n)), batch.column(0).slice(at, n), batch.column(1).slice(at, n),
                        pa.array(np.diff(stream.first)), pa.array(np.bincount(row[known], minlength=n)), pa.array(base),
                        pa.array(np.bincount(row, p, n)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(stream.ids[rare].view(np.int64))),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )
                uid += n

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(batches_of, SCORED)


def language_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token of every row of ``docs``.

    Training reads the rows that are not held out. Null and empty texts are one end token. Rows that repeat a doc_id
    are scored each. Without training rows every token is unseen. The empty table gives no row.
    """
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = stored(word_counts(training), "counts")
    model = fit(training, counts, rounds)
    rows = stored(score_rows(docs, model), "scored")
    rare = rows.select("uid", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h", "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.count("n").alias("rare_known")
    )
    denominator = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    full = rows.drop("rare").join(rare, "uid", "left")
    log = F.coalesce("rare_log", F.lit(0.0))
    score = F.col("score") + log
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        score.alias("score"), (-score * F.lit(float(np.log2(10))) / F.col("n_tokens")).alias("bits_per_token"),
    )
