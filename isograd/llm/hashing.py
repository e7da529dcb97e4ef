"""Hashes of words, shingles and byte windows over arrays of UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's or window's value is a polynomial over random byte values,
taken from one running sum, and then mixed to 64 bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _VALUE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        n = max(n, 1 << 16)
        base = np.full(n, _BASE, np.uint64)
        base[0] = 1
        back = np.full(n, _INVERSE, np.uint64)
        back[0] = 1
        _power, _inverse = np.multiply.accumulate(base), np.multiply.accumulate(back)
    return _power[:n], _inverse[:n]


def running(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running sums of the polynomial; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    power, _ = _powers(len(data) + 1)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * power[:len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from low to high, wherever they stand."""
    _, inverse = _powers(len(sums))
    value = (sums[high] - sums[low]) * inverse[low]
    return mix(value + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def every_span(sums: np.ndarray, size: int) -> np.ndarray:
    """The same hashes of all windows of a size."""
    _, inverse = _powers(len(sums))
    value = (sums[size:] - sums[:-size]) * inverse[:len(sums) - size]
    return mix(value + np.uint64(size * 0xD6E8FEB86659FD93 & 2 ** 64 - 1))


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words of each text, and each text's first word."""
    space = _SPACE[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = space[:-1]
    cut[offsets] = True
    inside = ~space
    starts = np.flatnonzero(inside & cut[:-1])
    cut[1:-1] = space[1:]
    cut[offsets] = True
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True):
    """Hash of every word (A-Z as a-z), and each text's first word, one entry more than texts."""
    starts, ends, first = word_bounds(data, offsets)
    return spans(running(data, fold), starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int):
    """Distinct shingles of each text: their hashes, in order, and each text's first one.

    A text with fewer words has its whole sequence as the one shingle; without words it has none.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        part = mix(hashes + np.uint64(j + 1)) if j else hashes
        if j == 0:
            value += part
        else:
            value[:n - j] = value[:n - j] * np.uint64(_BASE) + part[j:]
    whole = np.arange(n) + size <= first[1:][owner]
    value = mix(value)
    for text in np.flatnonzero((counts > 0) & (counts < size)):
        low, high = first[text], first[text + 1]
        total = np.full(1, high - low, np.uint64)
        for h in hashes[low:high]:
            total = mix(total * np.uint64(_BASE) ^ h)
        value[low], whole[low] = total[0], True
    value, owner = value[whole], owner[whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))
