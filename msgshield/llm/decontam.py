"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

A passage is a window of three lengths of the longest item, one after each length; its distinct words are the query. A copy
with insertions lies in one passage as a whole if it is at most twice as long as the longest item. An item's threshold is
the least score that a passage can have that passes the verification, so retrieval loses nothing. Blocks of items are
skipped when their block maxima cannot reach the least threshold of the block (block-max WAND, done for thousands of
passages at once); the items of the remaining blocks are scored exactly, and those at or above their threshold are verified by the
share of their 5-word shingles that occur in the passage: those of the whole item, or else those of its question and
those of its answer.

Words are runs of letters and digits, lower-cased, so other punctuation, case or line breaks hide nothing.

The index is built from bounded parts of the item table, one pass over the documents for each part, so a large set of
items costs more passes and not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Shared, stored, word_count
from .words import PUNCTUATION, Words, grams, hashes, rows_of, slices, split

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
BLOCK_ITEMS = 8
# Lengths of the longest item in a passage.
SEGMENTS = 3
# Words of test items in one index.
WORDS_PER_PASS = 1_000_000
SLICE_BYTES = 1 << 21
ENDINGS = np.frombuffer(b".?!:", dtype=np.uint8)


def bare_words(texts: pa.Array) -> Words:
    """Runs of letters and digits, in lower case of any script."""
    return split(pc.utf8_lower(texts.fill_null("")), PUNCTUATION)


def expand(pointer: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, entry): the entries ``pointer[r]`` to ``pointer[r + 1]`` of every row, and which row asked for them."""
    counts = pointer[rows + 1] - pointer[rows]
    owner = np.repeat(np.arange(len(rows)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - pointer[rows], counts)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, values, len(unique))


@dataclass
class Part:
    """A whole item, its question or its answer: distinct shingles of ``size`` words."""

    size: int
    shingles: np.ndarray


@dataclass
class Index:
    """Terms in order of their hash, with postings of items and of blocks of items."""

    items: np.ndarray
    terms: np.ndarray
    item_at: np.ndarray
    item_of: np.ndarray
    weight: np.ndarray
    block_at: np.ndarray
    block_of: np.ndarray
    bound: np.ndarray
    highest: np.ndarray
    essential: np.ndarray
    threshold: np.ndarray
    block_threshold: np.ndarray
    parts: list[list[Part]]
    wholes: list[Part] | None
    longest: int


def _parts(words: np.ndarray, closes: np.ndarray) -> list[np.ndarray]:
    """Question and answer: the answer is the last sentence, or as many as have five words; without a question of five
    words before it the item is all question."""
    for cut in np.flatnonzero(closes[:-1])[::-1] + 1:
        if len(words) - cut >= SHINGLE:
            return [words[:cut], words[cut:]] if cut >= SHINGLE else [words]
    return [words]


def _part(words: np.ndarray) -> Part:
    size = min(SHINGLE, len(words))
    return Part(size, np.unique(grams(words, size)))


def _spare(words: np.ndarray, part: Part) -> int:
    """How many words a passage may lack that holds ``OVERLAP`` of the part's shingles."""
    # Each word that a passage lacks spoils a shingle of its own at least; repeated shingles are counted once.
    return int((1 - OVERLAP) * len(part.shingles) + 1e-9) + len(words) - part.size + 1 - len(part.shingles)


def build_index(items: list[tuple[int, str]], whole: bool = False) -> Index | None:
    """The index of (item_id, text) rows; null and empty texts are left out. None if nothing is left.

    ``whole``: a passage is a hit too if it holds ``OVERLAP`` of the whole item's shingles.
    """
    words = bare_words(pa.array([t for _, t in items], pa.string()))
    ids = hashes(words)
    closes = np.isin(np.append(words.data, 0)[words.end], ENDINGS)
    rows = [r for r in range(len(items)) if words.first[r + 1] > words.first[r]]
    if not rows:
        return None
    rows.sort(key=lambda r: (words.first[r + 1] - words.first[r], items[r][0]))
    each = [ids[words.first[r] : words.first[r + 1]] for r in rows]
    lengths = np.array([len(x) for x in each])
    item = np.repeat(np.arange(len(each)), lengths)
    terms, term = np.unique(np.concatenate(each), return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * len(each) + item, return_counts=True)
    term, item = pair // len(each), pair % len(each)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(each) - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / lengths.mean()))
    item_at = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = -(-len(each) // BLOCK_ITEMS)
    pair, at = np.unique(term * blocks + item // BLOCK_ITEMS, return_inverse=True)
    bound = np.zeros(len(pair))
    np.maximum.at(bound, at, weight)
    block_at = np.searchsorted(pair // blocks, np.arange(len(terms) + 1))
    highest = np.zeros(len(terms))
    np.maximum.at(highest, term, weight)
    parts, wholes, threshold = [], [], np.zeros(len(each))
    # The weights of each item's terms, ascending.
    by_item = weight[np.lexsort((weight, item))]
    item_first = np.searchsorted(np.sort(item), np.arange(len(each) + 1))
    for i, (row, item_words) in enumerate(zip(rows, each, strict=True)):
        pieces = _parts(item_words, closes[words.first[row] : words.first[row + 1]])
        parts.append([_part(p) for p in pieces])
        spare = sum(_spare(p, x) for p, x in zip(pieces, parts[-1], strict=True))
        if whole:
            wholes.append(_part(item_words))
            spare = max(spare, _spare(item_words, wholes[-1]))
        own = by_item[item_first[i] : item_first[i + 1]]
        threshold[i] = own[: max(0, len(own) - spare)].sum() * (1 - 1e-9)
    block_threshold = np.minimum.reduceat(threshold, np.arange(0, len(each), BLOCK_ITEMS))
    # The most frequent terms, as long as they cannot reach any threshold by themselves, need no list of blocks.
    order = np.argsort(-df, kind="stable")
    essential = np.ones(len(terms), dtype=bool)
    essential[order[np.cumsum(highest[order]) < 0.5 * threshold.min()]] = False
    return Index(
        np.array([items[r][0] for r in rows], dtype=np.int64), terms, item_at, item, weight, block_at,
        pair % blocks, bound, highest, essential, threshold, block_threshold, parts, wholes if whole else None,
        int(lengths.max()),
    )


def search(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Verified hits of a slice of texts: (row, item, score, question overlap, answer overlap, first word), one of each
    row and item: the passage with the highest score, then the first."""
    words = bare_words(texts)
    ids = hashes(words)
    if not len(ids):
        return
    row = rows_of(words.first)
    length = np.diff(words.first)
    segments = -(-length // index.longest)
    base = np.cumsum(segments) - segments
    segment = base[row] + (np.arange(len(ids)) - words.first[row]) // index.longest
    term = np.searchsorted(index.terms, ids)
    term[term == len(index.terms)] = 0
    known = index.terms[term] == ids
    segment, term, row = segment[known], term[known], row[known]
    # Passage p: segments p to p + SEGMENTS - 1 of one text; a text with fewer segments is one passage.
    offset = segment - base[row]
    passage, carried = [], []
    for back in range(SEGMENTS):
        inside = (offset >= back) & (offset - back <= np.maximum(segments[row] - SEGMENTS, 0))
        passage.append(segment[inside] - back)
        carried.append(term[inside])
    passage, term = np.concatenate(passage), np.concatenate(carried)
    n = len(index.terms)
    pair = np.unique(passage * n + term)
    passage, term = pair // n, pair % n
    essential = index.essential[term]
    rest = np.bincount(passage[~essential], index.highest[term[~essential]], int(segments.sum()))
    owner, entry = expand(index.block_at, term[essential])
    blocks = len(index.block_threshold)
    key, bound = summed(passage[essential][owner] * blocks + index.block_of[entry], index.bound[entry])
    key = key[bound + rest[key // blocks] >= index.block_threshold[key % blocks]]
    if not len(key):
        return
    left = np.isin(passage, key // blocks)
    passage, term = passage[left], term[left]
    owner, entry = expand(index.item_at, term)
    live = np.isin(passage[owner] * blocks + index.item_of[entry] // BLOCK_ITEMS, key)
    items = len(index.items)
    key, score = summed(passage[owner[live]] * items + index.item_of[entry[live]], index.weight[entry[live]])
    live = score >= index.threshold[key % items]
    key, score = key[live], score[live]
    text_of = np.searchsorted(base + segments, key // items, side="right")
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for k, s, r in zip(key.tolist(), score.tolist(), text_of.tolist(), strict=True):
        first = words.first[r] + (k // items - base[r]) * index.longest
        inside = ids[first : min(first + SEGMENTS * index.longest, words.first[r + 1])]
        shares = [float(np.isin(p.shingles, grams(inside, p.size)).mean()) for p in index.parts[k % items]]
        accepted = min(shares) >= OVERLAP
        if not accepted and index.wholes is not None:
            p = index.wholes[k % items]
            accepted = float(np.isin(p.shingles, grams(inside, p.size)).mean()) >= OVERLAP
        if accepted and s > best.get((r, k % items), (-1.0,))[0]:
            best[r, k % items] = (s, shares[0], shares[-1], int(first - words.first[r]))
    for (r, i), found in best.items():
        yield r, i, *found


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item, text): the different texts of the items, each named by its hash. Only these are indexed."""
    texts = benchmark.filter("text IS NOT NULL").select("text").distinct()
    return texts.select(F.xxhash64("text").alias("item"), "text")


def indexes(benchmark: DataFrame, whole: bool = False) -> Iterator[Index]:
    """One index for each bounded part of the different items; they are dealt to the parts by hash."""
    items = distinct_items(benchmark)
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    passes = max(1, -(-total // WORDS_PER_PASS))
    for k in range(passes):
        rows = items.filter(F.pmod("item", F.lit(passes)) == k).toArrow().to_pylist()
        index = build_index([(r["item"], r["text"]) for r in rows], whole)
        if index is not None:
            yield index


def hits(docs: DataFrame, benchmark: DataFrame, *carry: Column, whole: bool = False) -> DataFrame:
    """Verified pairs: the columns ``carry`` of the document, item_id, bm25, question_overlap, answer_overlap, first_word.

    One row for each row of ``docs`` and item; first_word is where the passage begins. Null and empty texts hit
    nothing, empty items are hit by nothing; rows that repeat an item_id are items of their own. No items: no rows.
    ``whole``: 0.8 of the whole item's shingles suffice, then question or answer overlap may be less; else both must
    reach 0.8.
    """
    rows = docs.select(*carry, F.col("text").alias("__text"))
    fields = [StructField("__item", LongType())]
    fields += [StructField(c, DoubleType()) for c in ("bm25", "question_overlap", "answer_overlap")]
    schema = StructType([*rows.schema.fields[:-1], *fields, StructField("first_word", LongType())])
    out = None
    for index in indexes(benchmark, whole):
        shared = Shared(docs.sparkSession, index)

        def query(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.load()
            for batch in batches:
                found = []
                for at, piece in slices(batch.column(batch.num_columns - 1), SLICE_BYTES):
                    found += [(at + r, *hit) for r, *hit in search(index, piece)]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                picked = [c.take(pa.array(columns[0], pa.int64())) for c in batch.columns[:-1]]
                made = [pa.array(index.items[np.array(columns[1], dtype=np.int64)])]
                made += [pa.array(c, pa.float64()) for c in columns[2:5]] + [pa.array(columns[5], pa.int64())]
                yield pa.RecordBatch.from_arrays([*picked, *made], names=schema.names)

        part = rows.mapInArrow(query, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    # A hit of a text is one of every item with that text.
    named = benchmark.filter("text IS NOT NULL").select(F.xxhash64("text").alias("__item"), F.col("item_id").cast("long").alias("__id"))
    kept = [F.col(f.name) for f in rows.schema.fields[:-1]]
    measures = ["bm25", "question_overlap", "answer_overlap", "first_word"]
    return out.join(named, "__item").select(*kept, F.col("__id").alias("item_id"), *measures)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hit an item, as a whole or in question and answer; rows without text stay.

    Rows that repeat stay or go together. Other columns are kept as they are; without items all rows stay.
    """
    at = docs.columns.index("text")
    for k, index in enumerate(indexes(benchmark, whole=True)):
        if k:
            # A pass ends before the next index is loaded, so a task holds one of them.
            docs = stored(docs, "clean")
        shared = Shared(docs.sparkSession, index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.load()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, piece in slices(batch.column(at), SLICE_BYTES):
                    for row, *_ in search(index, piece):
                        clean[first + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
