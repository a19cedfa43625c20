"""Vectorised words of Arrow text columns.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which is `[^\\x20\\x09-\\x0D]+` on
UTF-8. All functions work on one byte buffer that holds many texts, so Python never loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=U64)
#: Text handled at once: bounds the memory of a Python worker however large a batch is.
SLICE_BYTES = 1 << 20


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, offsets starting at 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (a longer text stands alone)."""
    if not len(texts):
        return
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end
        at = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


def words(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; words never cross texts. blank: which bytes stand between words."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~blank[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...] = (1, 2)
) -> list[np.ndarray]:
    """One 64-bit hash of each word for every seed, taken over 8 bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    out = [mix(length.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) for seed in seeds]
    which, lane = np.arange(len(start)), 0
    while len(which):
        rest = length[which] - 8 * lane
        part = eight[start[which] + 8 * lane] & _KEEP[np.minimum(rest, 8)]
        for h in out:
            h[which] = mix(h[which] * U64(0x9FB21C651E98DF25) ^ part)
        which, lane = which[rest > 8], lane + 1
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions, not texts, are minded here)."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    out = np.zeros(count, U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + h[k : k + count]
    return mix(out)

