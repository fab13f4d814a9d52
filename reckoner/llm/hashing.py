"""Vectorised 64-bit polynomial hashes of words and of windows of consecutive words."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, so that they have inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD1342543DE82EF95 | 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, at least n of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = tuple(made)
    return _powers[base]


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more than texts); apart: for each byte, whether it stands between words (white space, if not given)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = apart[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[:-1], after[-1] = before[1:], True
    after[:-1] |= space[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each values[start:end], by differences of one running sum."""
    power, inverse = _tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each text's first word; apart as in word_spans()."""
    starts, ends, first = word_spans(data, offsets, apart)
    return _ranges(data.astype(np.uint64) + np.uint64(1), BYTE_BASE, starts, ends), first


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hash of each window of `width` words inside one text, and the index of the window's first word."""
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    total = int(counts.sum())
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return _ranges(words, WORD_BASE, at, at + width), at
