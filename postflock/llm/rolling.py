"""Rolling hashes in numpy: polynomials modulo 2**64 over prefix sums, so that no loop runs over positions.

With S[i] the sum of c[j] * BASE**j over j < i, the hash of the positions a to b is (S[b] - S[a]) / BASE**a.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE_WORDS = 5
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=16)
def _powers(size: int, base: int) -> np.ndarray:
    powers = np.full(size, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _table(size: int, base: int) -> np.ndarray:
    return _powers(max(1 << 12, 1 << size.bit_length()), base)[:size]


def _inverse(size: int) -> np.ndarray:
    return _table(size, INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's high bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum(values * _table(values.size, BASE), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values."""
    return (sums[width:] - sums[:-width]) * _inverse(sums.size - width)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(SPACES[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(raw.astype(np.uint64) + np.uint64(1))
    return mixed((sums[ends] - sums[starts]) * _inverse(raw.size)[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of hashes of all runs of ``words`` words, sorted; the whole sequence as one if it is shorter;
    empty without words."""
    hashes = word_hashes(text)
    if not hashes.size:
        return hashes
    width = min(words, hashes.size)
    return np.unique(mixed(window_hashes(prefix_sums(hashes), width) + np.uint64(width)))
