"""Word n-grams of Arrow batches, interned in open-addressed numpy tables.

A table has keys (the XXH64 of an n-gram's bytes), an owner (an occurrence), and beside them the bucket and the number
of occurrences of its n-gram. Two occurrences share a slot only if their bytes are equal: words are compared byte by
byte, longer n-grams by the slots of their words. Everything is done for all occurrences of a piece at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from .words import rows_of, slices, split

# Words are runs of digits, letters (lower-cased) and all characters beyond ASCII.
GAPS = np.array([c < 128 and not (48 <= c < 58 or 97 <= c < 123) for c in range(256)])
# Words that are looked at together; a longer text is looked at in pieces.
PIECE_WORDS = 1 << 18
# Lengths with fewer spans are hashed one by one.
FEW = 24
LONGEST_SHIFT = 128

_U = np.uint64
_M1, _M2, _M3, _M4, _M5 = map(
    _U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turn(x * _M2, 31) * _M1


def _equal_spans(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 with seed 0 of spans of one length. ``data`` goes on for eight bytes after the last span."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    half = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    done = 0
    if size >= 32:
        start = np.array([_M1 + _M2, _M2, _U(0), _U(0) - _M1], dtype=_U)
        state = [np.full(len(at), s) for s in start]
        while done + 32 <= size:
            for i in range(4):
                state[i] = _turn(state[i] + wide[at + (done + 8 * i)] * _M2, 31) * _M1
            done += 32
        out = _turn(state[0], 1) + _turn(state[1], 7) + _turn(state[2], 12) + _turn(state[3], 18)
        for s in state:
            out = (out ^ _lane(s)) * _M1 + _M4
    else:
        out = np.full(len(at), _M5)
    out += _U(size)
    while done + 8 <= size:
        out = _turn(out ^ _lane(wide[at + done]), 27) * _M1 + _M4
        done += 8
    if done + 4 <= size:
        out = _turn(out ^ (half[at + done].astype(_U) * _M1), 23) * _M2 + _M3
        done += 4
    while done < size:
        out = _turn(out ^ (data[at + done].astype(_U) * _M5), 11) * _M1
        done += 1
    out = (out ^ (out >> _U(33))) * _M2
    out = (out ^ (out >> _U(29))) * _M3
    return out ^ (out >> _U(32))


def xxh64(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of the spans ``data[at:at + size]``."""
    out = np.empty(len(at), dtype=_U)
    if not len(at):
        return out
    with np.errstate(over="ignore"):
        narrow = size.astype(np.uint16) if size.max() < 1 << 16 else size
        order = np.argsort(narrow, kind="stable")
        limits = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            members = order[a:b]
            length = int(size[members[0]])
            if b - a < FEW:
                view = memoryview(data)
                out[members] = [xxhash.xxh64_intdigest(view[i : i + length]) for i in at[members].tolist()]
            else:
                out[members] = _equal_spans(data, at[members], length)
    return out


def same_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether spans ``a`` and spans ``b`` hold the same bytes."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = size[a] == size[b]
        open_, done = np.flatnonzero(equal), 0
        while len(open_):
            left = size[a[open_]] - done
            shift = (_U(8) * np.maximum(8 - left, 0).astype(_U)).astype(_U)
            differ = (wide[at[a[open_]] + done] ^ wide[at[b[open_]] + done]) << shift
            equal[open_[differ != 0]] = False
            open_ = open_[(differ == 0) & (left > 8)]
            done += 8
        return equal

    return same


class Table(NamedTuple):
    """Distinct n-grams: ``owner`` is an occurrence of each, ``count`` how many there are; ``slot``: the one of each occurrence."""

    slot: np.ndarray
    owner: np.ndarray
    count: np.ndarray


def intern(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Table:
    """Open addressing with linear probing, at most half full; all occurrences probe at once."""
    mask = (1 << max(1, (2 * len(keys) - 1).bit_length())) - 1
    owner = np.full(mask + 1, -1, dtype=np.int64)
    slot = (keys & _U(mask)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        at = slot[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]
        holder = owner[at]
        hit = keys[holder] == keys[left]
        hit[hit] = same(holder[hit], left[hit])
        left = left[~hit]
        slot[left] = (slot[left] + 1) & mask
    used = np.flatnonzero(owner >= 0)
    number = np.zeros(mask + 1, dtype=np.int64)
    number[used] = np.arange(len(used))
    slot = number[slot]
    return Table(slot, owner[used], np.bincount(slot, minlength=len(used)))


def _byte_table() -> np.ndarray:
    """The CRC-32 register after one zero byte, for each value of its lowest byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    return step


_BYTE = _byte_table()
_SHIFTS: list[np.ndarray] = []


def _shifts() -> np.ndarray:
    """CRC-32 registers moved on by n zero bytes: row n has a table for each byte of the register."""
    if not _SHIFTS:
        rows = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)]
        for _ in range(LONGEST_SHIFT):
            rows.append(_BYTE[rows[-1] & 255] ^ (rows[-1] >> 8))
        _SHIFTS.append(np.stack(rows))
    return _SHIFTS[0]


def append_crc(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of A and B joined, from that of A, that of B and the length of B, at most ``LONGEST_SHIFT``."""
    table = _shifts()
    out = more.copy()
    for i in range(4):
        out ^= table[size, i, (crc >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def crcs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of spans, byte by byte for all of them; long ones one by one."""
    order = np.argsort(size, kind="stable")
    at, sizes = at[order], size[order]
    few = int(np.searchsorted(sizes, LONGEST_SHIFT, side="right"))
    state = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    for done in range(int(sizes[few - 1]) if few else 0):
        a = int(np.searchsorted(sizes, done, side="right"))
        state[a:few] = _BYTE[(state[a:few] ^ data[at[a:few] + done]) & np.uint32(255)] ^ (state[a:few] >> np.uint32(8))
    state = ~state
    for i in range(few, len(at)):
        state[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


class Piece(NamedTuple):
    """The n-grams that begin in a piece: their ``row`` and, for each length, the table and the CRC-32 of its slots."""

    row: list[np.ndarray]
    tables: list[Table]
    crc: list[np.ndarray]


def _piece(data: np.ndarray, size: np.ndarray, row: np.ndarray, left: np.ndarray, begin: int, longest: int) -> Piece:
    """``data``: words with a blank after each; ``left``: words of the row from here on; the first ``begin`` words count."""
    at = np.cumsum(size + 1) - (size + 1)
    everything = same_bytes(data, at, size)
    words = intern(xxh64(data, at, size), everything)
    word = words.slot
    plain = crcs(data, at[words.owner], size[words.owner])
    blank = np.full(len(plain), zlib.crc32(b" "), dtype=np.uint32)
    # Read only where the word is short enough for ``append_crc``.
    spaced = append_crc(blank, plain, np.minimum(size[words.owner], LONGEST_SHIFT))
    own = word[:begin]
    first = Table(own, words.owner, np.bincount(own, minlength=len(words.owner)))
    rows, tables, sums = [row[:begin]], [first], [plain]
    # The CRC of the n-gram at every word; wrong where the row has too few words, and not read there.
    running, end = plain[word], at + size
    for n in range(2, longest + 1):
        if len(word) < n:
            break
        last = word[n - 1 :]
        running = running[: len(last)]
        long = size[n - 1 :] >= LONGEST_SHIFT
        running = append_crc(running, spaced[last], np.where(long, 0, size[n - 1 :] + 1))
        full = left[: len(last)] >= n
        for i in np.flatnonzero(long & full).tolist():
            running[i] = zlib.crc32(data[at[i] : end[i + n - 1]])
        here = np.flatnonzero(full[:begin])
        parts = [word[here + i] for i in range(n)]

        def same(a: np.ndarray, b: np.ndarray, parts: list[np.ndarray] = parts) -> np.ndarray:
            equal = parts[0][a] == parts[0][b]
            for p in parts[1:]:
                equal &= p[a] == p[b]
            return equal

        table = intern(xxh64(data, at[here], end[here + n - 1] - at[here]), same)
        rows.append(row[here])
        tables.append(table)
        sums.append(running[here[table.owner]])
    return Piece(rows, tables, sums)


def pieces(texts: pa.Array, longest: int) -> Iterator[Piece]:
    """The runs of 1 to ``longest`` words of a string array; rows are those of the array."""
    for base, part in slices(texts):
        words = split(part, GAPS)
        n = len(words.start)
        left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
        row = rows_of(words.first) + base
        for a in range(0, n, PIECE_WORDS):
            begin = min(PIECE_WORDS, n - a)
            b = min(a + begin + longest - 1, n)
            size = words.end[a:b] - words.start[a:b]
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            joined = np.full(int(size.sum()) + b - a + 8, 32, dtype=np.uint8)
            joined[within + np.repeat(np.cumsum(size + 1) - size - 1, size)] = words.data[within + np.repeat(words.start[a:b], size)]
            yield _piece(joined, size, row[a:b], left[a:b], begin, longest)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of every row."""
    out = np.zeros(len(texts), dtype=np.int64)
    for base, part in slices(texts):
        out[base : base + len(part)] = np.diff(split(part, GAPS).first)
    return out
