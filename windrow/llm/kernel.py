"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes outside a separator class, taken straight from
the UTF-8 buffer of an Arrow column: no Python string is made.  A word's hash
is a 64-bit sum of random byte values times position weights, finished by an
avalanche mix; equal words always have equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer single texts are handled alone.
CHUNK_BYTES = 1 << 20
_BLOCK = 4096


def _random64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random64(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE_LOWER[97:123]
_WEIGHT = _random64(12, _BLOCK)
_ROLE = _random64(13, 64)

#: Space and the ASCII controls 9 to 13 part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All ASCII but digits and letters part words.
NON_WORD = np.ones(256, bool)
NON_WORD[128:] = False
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def spans(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, off: np.ndarray, seps: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of rows whose bytes are ``data[off[0]:off[-1]]``.

    Returns (hashes, first word of each row with the total appended, start
    byte of each word from off[0]).
    """
    text, rel = data[off[0] : off[-1]], off - off[0]
    gap = seps[text]
    start = ~gap
    start[1:] &= gap[:-1] | False
    heads = rel[:-1][rel[:-1] < len(text)]
    start[heads] = ~gap[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), at
    counts = np.diff(np.append(at, len(text)))
    pos = np.arange(at[0], len(text)) - np.repeat(at, counts)
    value = (_BYTE_LOWER if lower else _BYTE)[text[at[0] :]]
    longest = int(counts.max())
    value *= _WEIGHT[pos & (_BLOCK - 1)]
    if longest > _BLOCK:
        # a word's first block keeps its weights, so that its hash does not depend on its neighbours
        factor = _random64(14, longest // _BLOCK + 1)
        factor[0] = 1
        value *= factor[pos >> 12]
    value[gap[at[0] :]] = 0
    return mix(np.add.reduceat(value, at - at[0])), np.searchsorted(at, rel), at


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; the whole text if shorter, none if empty."""
    if not len(h):
        return h
    w = min(k, len(h))
    out = np.zeros(len(h) - w + 1, np.uint64)
    for j in range(w):
        out += h[j : len(h) - w + 1 + j] * _ROLE[j]
    return mix(out + np.uint64(w))
