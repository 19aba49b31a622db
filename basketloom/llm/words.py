"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, after
A-Z are lower-cased. The hash of a word is a polynomial in its bytes, found for all words from one prefix sum.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, dtype=bool)
GAP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, kept as far as they were needed."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hashes(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes."""
    up, down = _POWERS.get(len(chars))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((chars.astype(np.uint64) + _U(1)) * up)))
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes], gap: np.ndarray = GAP, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and the number of words of each text."""
    joined = b" " + b" ".join(texts) + b" "
    chars = lower[np.frombuffer(joined, dtype=np.uint8)]
    is_gap = gap[chars]
    edge = np.flatnonzero(is_gap[1:] != is_gap[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    hashes = span_hashes(chars, begin, end)
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(begin, stops))))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of each text, repeats included, and their numbers.

    A text with fewer words, but one at least, has its whole sequence as one shingle; one without words has none.
    """
    n = len(words)
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    with np.errstate(over="ignore"):
        padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
        h = np.zeros(len(begin), dtype=np.uint64)
        long = np.repeat(counts >= width, sizes)
        factor = 1
        for k in range(width):
            factor = factor * 0xA24BAED4963EE407 & MASK
            part = padded[begin + k] * _U(factor)
            if not long.all():
                part = np.where(long | (k < np.repeat(counts, sizes)), part, _U(0))
            h += part
        h += np.repeat(np.minimum(counts, width), sizes).astype(np.uint64) * _U(0x9FB21C651E98DF25)
    return mix(h), sizes
