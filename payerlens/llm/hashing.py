"""Words of whole Arrow string columns as arrays: places and 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_BLANK = np.isin(_PLAIN, (9, 10, 11, 12, 13, 32))
_ALNUM = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_PLAIN > 127)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


#: Random numbers of the bytes.
_BYTE = scramble(scramble(np.arange(1, 257, dtype=np.uint64) * _STEP))


@dataclass
class Words:
    """The words of a column of texts, one text after the other."""

    data: np.ndarray  # the bytes after lower-casing
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    upto: np.ndarray  # number of words before each text, and of all

    def of(self, text: int) -> slice:
        return slice(int(self.upto[text]), int(self.upto[text + 1]))

    def joined(self, low: int, high: int) -> bytes:
        """The words from low to high with single blanks."""
        return b" ".join(
            self.data[a:b].tobytes() for a, b in zip(self.begins[low:high].tolist(), self.ends[low:high].tolist())
        )


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place of each text's start and of the end) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    edges = edges.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def words_of(column: pa.Array, lower: bool = True, alnum: bool = False) -> Words:
    """Words between blanks (space and U+0009 to U+000D), or of 0-9, a-z and non-ASCII characters.

    ``lower`` lower-cases A-Z. The hash of a word is a sum of its bytes' random numbers
    times powers of an odd number, scrambled.
    """
    raw, edges = _bytes_of(column)
    data = _LOWER[raw] if lower else raw
    inside = _ALNUM[data] if alnum else ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(raw)]
    first[heads] = inside[heads]
    begins = np.flatnonzero(first)
    last = np.zeros(len(raw), bool)
    if len(raw):
        last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
        last[-1] = inside[-1]
    ends = np.flatnonzero(last) + 1
    upto = np.searchsorted(begins, edges)
    if not len(begins):
        return Words(data, begins, ends, np.zeros(0, np.uint64), upto)
    sizes = ends - begins
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _STEP, np.uint64))
    kept = np.flatnonzero(inside)
    shift = np.cumsum(sizes) - sizes
    place = np.arange(len(kept)) - np.repeat(shift, sizes)
    hashes = scramble(np.add.reduceat(_BYTE[data[kept]] * powers[place], shift))
    return Words(data, begins, ends, hashes, upto)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = (h * _MIX + (h >> np.uint64(32))) ^ words[j : j + n]
    return scramble(h)
