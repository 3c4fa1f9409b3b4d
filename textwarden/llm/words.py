"""Word and shingle hashes of many texts at once, straight from the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A
word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then
mixed; a shingle's hash is a polynomial over its words' hashes, mixed again.  All texts
of a piece are hashed together: there is no Python object per word.

Hashes have 64 bits and are only ever compared between the shingles of two texts, so
the chance of a wrong match depends on the length of the texts, not on their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed together; a longer text is a piece of its own

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_M1, _M2, _M3 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(_M1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(_M2)
    h ^= h >> np.uint64(31)
    return h


def _byte_values(fold: bool) -> np.ndarray:
    """One 64-bit value per byte; A-Z share those of a-z if they are to be folded."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M3))
    if fold:
        values[65:91] = values[97:123]
    return values


def _spaces() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


class Hasher:
    """Hashes words and shingles; holds the powers that the pieces of a task share."""

    def __init__(self, fold: bool = True):
        self.values, self.space = _byte_values(fold), _spaces()
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _STEP, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BACK, np.uint64)])

    def spans(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of every word of texts data[cuts[i]:cuts[i+1]]."""
        n = len(data)
        inside = ~self.space[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = cuts[(cuts > 0) & (cuts < n)]  # a word ends where its text ends
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last)

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts data[cuts[i]:cuts[i+1]], and where each text's words begin."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
        self._powers(n + 1)
        starts, ends = self.spans(data, cuts)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        h = (sums[ends + 1] - sums[starts]) * self.down[starts]
        h += (ends - starts).astype(np.uint64)
        return mixed(h), np.searchsorted(starts, cuts)

    def shingles(self, words: np.ndarray, begin: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """For each text its shingle hashes, in order; a text of fewer words gives one over them all."""
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width if len(rolled) else 0):
            rolled = rolled * np.uint64(_M3) + words[j : len(words) - width + 1 + j]
        rolled = mixed(rolled + np.uint64(width))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= width:
                yield rolled[a : b - width + 1]
            elif b > a:
                h = 0
                for w in words[a:b].tolist():
                    h = (h * _M3 + w) % (1 << 64)
                yield mixed(np.array([(h + b - a) % (1 << 64)], np.uint64))
            else:
                yield words[:0]


def pieces(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of neighbouring texts of PIECE (or ``size``) bytes: index of the first, their bytes, their cuts.  Nulls are empty."""
    size = size or PIECE
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_rows(texts: pa.Array, width: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """Shingle hashes (int64, in order, with repeats) of every text of a column."""
    for _, data, cuts in pieces(texts):
        words, begin = hasher.words(data, cuts)
        for h in hasher.shingles(words, begin, width):
            yield h.view(np.int64)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    if len(h) < 2:
        return h
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def list_array(rows: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """An Arrow list of the rows."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
