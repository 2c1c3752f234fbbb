"""Words of many texts at once: byte positions and 64-bit hashes, without a Python object per word.

All hashes are polynomials modulo 2**64 over prefix sums, so the hash of any run of bytes or of words is two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Odd multipliers (invertible modulo 2**64) of the byte and the word polynomials; the second of each is for a second hash.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASE = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
BREAKS = WHITE.copy()
BREAKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(m, base, U), np.full(m, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        got = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers; one longer than the values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end]."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start])


def ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] numbers), then those of at[1], and so on."""
    return np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)


@dataclass
class Words:
    """Words of consecutive texts; ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, second: bool = False) -> np.ndarray:
        b = BYTE_BASE[second]
        prefix = sums(self.data.astype(U) + U(1), b) if second else self.prefix
        return span(prefix, self.start, self.end, b)

    def heads(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word; 0 for shorter words."""
        h = span(self.prefix, self.start, np.minimum(self.start + n, self.end), BYTE_BASE[0])
        return np.where(self.end - self.start >= n, h, U(0))


def words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = WHITE, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not in ``breaks``; ``fold`` maps bytes first."""
    if fold is not None:
        data = fold[data]
    inside = ~breaks[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= begin[1:] | ~inside[1:]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(end) + 1, np.searchsorted(start, off), sums(data.astype(U) + U(1), BYTE_BASE[0]), data)


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions from which k words of the same text follow."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    has = np.maximum(np.diff(first) - k + 1, 0)
    on = has > 0
    np.add.at(ok, first[:-1][on], 1)
    np.add.at(ok, (first[:-1] + has)[on], -1)
    return np.flatnonzero(np.cumsum(ok)[:n])
