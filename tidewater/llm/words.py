"""Words of Arrow string columns as NumPy arrays. A word is a run of bytes outside \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _S1, _S2, _S3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(30), np.uint64(27), np.uint64(31)
#: Odd bases of the rolling polynomials modulo 2**64: bytes of a word, words of a window, words of a window again.
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of uint64 values; works in place."""
    h ^= h >> _S1
    h *= _M1
    h ^= h >> _S2
    h *= _M2
    h ^= h >> _S3
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (pair[0], pair[1])
    return have


class Words:
    """Words of consecutive texts: buf bytes, text i at bytes[i]:bytes[i+1], its words at first[i]:first[i+1] of start and end."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        wide = pa.types.is_large_string(column.type)
        o = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        self.buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bytes = o - o[0]
        self.space = SPACE[self.buf]
        n = len(self.buf)
        edge = np.zeros(n + 1, bool)
        edge[self.bytes] = True
        text = ~self.space
        begin = text & edge[:-1]
        begin[1:] |= text[1:] & self.space[:-1]
        last = text & edge[1:]
        last[:-1] |= text[:-1] & self.space[1:]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.bytes)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit polynomial hash of each word."""
        n = len(self.buf)
        p, inverse = powers(BYTE_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h)

    def windows(self, length: int) -> np.ndarray:
        """Index of the first word of every window of that many words inside one text."""
        room = np.maximum(self.count - length + 1, 0)
        at = np.arange(int(room.sum()), dtype=np.int64)
        return at + np.repeat(self.first[:-1] - (np.cumsum(room) - room), room)


def rolling(h: np.ndarray, at: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of the windows of that many values that start at the given places, from one pass of prefix sums."""
    p, inverse = powers(base, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * inverse[at])


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about that many bytes of text each; one row at least."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    o = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, j
        i = j
