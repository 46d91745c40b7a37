"""Packing documents into training sequences by lexical retrieval.

The documents are cut into shards of bounded size that follow source and doc_id. A shard is tokenised and indexed in
one task: an inverted index over its token ids with BM25 impacts. The document that opens a sequence is its seed; the
unused documents that share any of its terms, best first by the whole score, fill the rest of the window. The one that
no longer fits is cut there and opens, as the next seed, the next window; so only the last sequence of a shard has
padding.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

WINDOW = 1024
# Closes every document.
END = 0
# UTF-8 bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
# BM25, and the rarest terms of a seed that are looked up: all.
K1 = 1.2
B = 0.75
QUERY_TERMS = None
# Terms that more than one document in so many holds have a row of impacts instead of postings.
DENSE = 16

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
# Texts with a longer run of characters without white space go to the tokenizers library: merging takes long there.
LONG_RUN = re.compile(r"(?<!\S)\S{4000}|(?<!\s)\s{4000}")
# Such a run holds a whole block of half its length, counted from the start of the text; few other texts have one.
BLOCK = 2000
EVEN_BLOCK = re.compile(rf"\S{{{BLOCK}}}|\s{{{BLOCK}}}")


def long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` finds a run."""
    even = any(EVEN_BLOCK.match(text, at) for at in range(0, len(text) - BLOCK + 1, BLOCK))
    return even and LONG_RUN.search(text) is not None


def byte_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level BPE without its added tokens; None for any other kind of tokenizer.

    In the file printable bytes stand for themselves and the others, in order, for the characters from 256 on.
    """
    model, cut = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or not byte_level or tokenizer["normalizer"] or tokenizer.get("truncation") or tokenizer.get("padding"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [c for c in range(256) if c not in shown]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
    added = {t["content"] for t in tokenizer["added_tokens"]}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}


class Coder:
    """Token ids of texts as the tokenizers library gives them for its file, without special tokens.

    If the file is a plain byte-level BPE, tiktoken computes the same ids from its ranks, several times as fast; texts
    with the string of an added token, and very long runs without white space, are left to the tokenizers library.
    """

    # The words that byte-level pre-tokenizers cut; fixed by their format.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, tokenizer: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(json.loads(tokenizer))
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("given", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or long_run(text) or any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(array("I", ids), dtype="<u4")


class Index:
    """BM25 index of a shard; terms are token ids. Common terms have a row of impacts, the others postings."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        found = [np.unique(d[:-1], return_counts=True) for d in docs]
        size = np.array([len(t) for t, _ in found], dtype=np.int64)
        terms = np.concatenate([np.zeros(0, np.uint32), *[t for t, _ in found]])
        counts = np.concatenate([np.zeros(0), *[c for _, c in found]])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), size)
        length = np.array([len(d) for d in docs], dtype=float)
        self.terms = [t for t, _ in found]
        self.df = np.bincount(terms, minlength=1)
        idf = np.log1p((len(docs) - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1.0)) if len(docs) else length
        impact = idf[terms] * counts * (K1 + 1) / (counts + norm[doc])
        # Multiples of one unit, so small that any sum of a document's impacts is exact in single precision.
        unit = 2.0 ** (np.ceil(np.log2(np.bincount(doc, impact, minlength=1).max() + 1)) - 23)
        impact = np.maximum(np.rint(impact / unit), 1) * unit
        dense = self.df * DENSE > len(docs)
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        at = self.row[terms]
        rows = np.zeros((self.row.max() + 1, len(docs)), np.float32)
        rows[at[at >= 0], doc[at >= 0]] = impact[at >= 0]
        self.rows = list(rows)
        terms, doc, impact = terms[at < 0], doc[at < 0], impact[at < 0]
        order = np.argsort(terms.astype(np.uint16) if len(self.df) <= 1 << 16 else terms, kind="stable")
        self.doc, self.impact = doc[order].astype(np.int64), impact[order]
        self.first = np.append(0, np.cumsum(np.where(self.row < 0, self.df, 0)))
        self.live = np.arange(len(docs))

    def keep(self, kept: np.ndarray) -> None:
        """Forgets the indexed documents outside the mask ``kept``; the statistics of the shard stay."""
        self.rows = [r[kept] for r in self.rows]
        of = kept[self.doc]
        self.doc, self.impact = (np.cumsum(kept) - 1)[self.doc[of]], self.impact[of]
        self.first = np.append(0, np.cumsum(of))[self.first]
        self.live = self.live[kept]

    def neighbours(self, doc: int, open_: np.ndarray, most: int | None = None) -> np.ndarray:
        """The documents of ``open_`` (a mask) that share a term with ``doc``, best first; the first ``most`` if given.

        A document outside ``open_`` must stay outside in later calls.
        """
        if np.count_nonzero(open_) * 4 < len(self.live) * 3:
            self.keep(open_[self.live])
        terms = self.terms[doc]
        df = self.df[terms]
        shared = df > 1
        terms = terms[shared][np.argsort(df[shared], kind="stable")[:QUERY_TERMS]]
        row = self.row[terms]
        terms = terms[row < 0]
        score = np.zeros(len(self.live), np.float32)
        if len(terms):
            start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
            places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            score += np.bincount(self.doc[places], self.impact[places], minlength=len(score))
        for r in row[row >= 0].tolist():
            score += self.rows[r]
        found = np.flatnonzero((score > 0) & open_[self.live])
        score = score[found]
        if most is not None and most < len(found):
            best = score >= np.partition(score, -most)[-most]
            found, score = found[best], score[best]
        return self.live[found[np.argsort(-score, kind="stable")][:most]]


def fill(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    index = Index(docs)
    open_ = np.ones(len(docs), dtype=bool)
    in_order, near = iter(range(len(docs))), iter(())
    sequence, room, seed = 0, window, -1
    for _ in range(len(docs)):
        doc = next((d for d in near if open_[d]), -1)
        if doc < 0:
            doc = seed = next(d for d in in_order if open_[d])
            fresh = True
        else:
            fresh = False
        open_[doc] = False
        start, size = 0, len(docs[doc])
        while start < size:
            if room == 0:
                sequence, room, seed, fresh = sequence + 1, window, doc, True
            length = min(room, size - start)
            yield doc, start, length, sequence, window - room
            start, room = start + length, room - length
        if room == 0:
            sequence, room, near = sequence + 1, window, iter(())
        elif fresh:
            # Every document has an id at least, so no more of them than ``room`` can follow in this window.
            near = iter(index.neighbours(seed, open_, room).tolist())


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[str]]]:
    """The rows of a partition, cut where they go beyond twice the size of a shard."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = len(text) if text else 0
            if ids and size + more > 2 * limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text or "")
            size += more
    if ids:
        yield ids, texts


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``docs``: doc_id, source, text; other columns are not read. ``tokenizer``: path of a file of the tokenizers
    library, read on the driver and broadcast. Every row is a document, also if it repeats another or has no doc_id;
    null and empty texts are the closing id alone. Sequences of one shard have consecutive ids. An empty table gives
    no row. The same input files give the same sequences.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        shared = Shared(spark, file.read())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").alias("__source"),
        F.monotonically_increasing_id().alias("__row"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The place in the input is the last key, so a hot key is spread over as many shards as its rows need.
    keys = [F.col("__source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("__row")]
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *keys).sortWithinPartitions(*keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Coder(shared.load())
        sequence = TaskContext.get().partitionId() << 36
        for ids, texts in _shards(batches, shard_bytes):
            coded = [np.append(coder.encode(x), np.uint32(END)) for x in texts]
            del texts
            made = list(fill(coded, window))
            for a in range(0, len(made), 4096):
                doc, start, length, number, offset = map(np.array, zip(*made[a : a + 4096], strict=True))
                cut = [coded[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(cut, pa.binary()),
                        pa.array([len(coded[d]) for d in doc], pa.int64()), pa.array(number + sequence), pa.array(offset),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            sequence += made[-1][3] + 1

    return dealt.select("doc_id", "text").mapInArrow(pieces, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, n_tokens, padding, ids: the pieces of each sequence joined. A power of two needs no padding."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
    whole = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", "n_tokens", F.when(whole, 0).otherwise(window - F.col("n_tokens")).alias("padding"), "ids")
