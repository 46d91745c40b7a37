"""Words of whole Arrow batches as numpy arrays, without a Python loop over words.

A word is a run of bytes other than blank and the controls 9 to 13; A-Z are lower-cased. Null texts have no words. A
word is named by a 64-bit hash of its bytes; among a billion different words two share a hash with a chance of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# All ASCII characters but letters and digits: for comparisons that look past punctuation.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PIECE = 1 << 19
# Bytes of text that are looked at together.
SLICE_BYTES = 1 << 21


class Words(NamedTuple):
    """``data``: the lowered bytes; word ``i`` is ``data[start[i]:end[i]]``; row ``r`` has words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``limit`` bytes with their first row; a longer text is a slice of its own."""
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, texts.slice(row, end - row)
        row = end


def split(texts: pa.Array, gaps: np.ndarray = _SPACE) -> Words:
    """The words of a string array; ``gaps`` tells for each byte whether it separates words."""
    n = len(texts)
    if n == 0 or texts.buffers()[2] is None:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(n + 1, np.int64))
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(n + 1, np.int64))
    inside = ~gaps[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    rows, last = at[:-1][full], at[1:][full] - 1
    begins[rows] = inside[rows]
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its bytes, from prefix sums over pieces of the data."""
    if not _POWERS:
        _POWERS.update(up=_powers(_BASE, _PIECE + 1), down=_powers(_INVERSE, _PIECE + 1))
    out = np.empty(len(words.start), dtype=np.uint64)
    word = 0
    while word < len(out):
        begin = int(words.start[word])
        stop = max(word + 1, int(np.searchsorted(words.end, begin + _PIECE, side="right")))
        start, end = words.start[word:stop] - begin, words.end[word:stop] - begin
        size = int(end[-1])
        power, inverse = _POWERS["up"], _POWERS["down"]
        if size > _PIECE:
            power, inverse = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[words.data[begin : begin + size]] * power[:size], out=sums[1:])
        out[word:stop] = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        word = stop
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mixed(out * _BASE + words[i : i + n])
    return out
