"""Word hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of white space: space and \\t to \\r.
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of BASE modulo 2 ** 64, grown as needed."""
    global _POWERS
    with np.errstate(over="ignore"):
        while len(_POWERS) < n:
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * BASE)])
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = _SPACES, letters: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of the lower-cased texts, and the n + 1 offsets of the texts' words.

    A word is a run of bytes outside ``spaces`` within one text; ``letters`` are the byte values that its hash is made of.
    """
    inside = ~spaces[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, counts
    size = ends - starts
    longest = int(size.max())
    with np.errstate(over="ignore"):
        low = letters[data].astype(np.uint64) + np.uint64(1)
        low[~inside] = 0
        place = np.zeros(len(data), np.int64)
        place[starts] = starts
        np.maximum.accumulate(place, out=place)
        place = np.arange(len(data)) - place
        np.minimum(place, longest - 1, out=place)  # white space after a word; its value is 0
        low *= powers(longest)[place]
        hashes = np.add.reduceat(low, starts)
    return mix(hashes + size.astype(np.uint64)), starts, ends, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a text, and the offsets of the texts' runs; a text with fewer words, but
    at least one, has its whole sequence as its one run."""
    n = np.diff(counts)
    rows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(rows)])
    at = np.repeat(counts[:-1] - ends[:-1], rows) + np.arange(ends[-1])
    have = np.repeat(np.minimum(n, width), rows)
    with np.errstate(over="ignore"):
        value = have.astype(np.uint64)
        for k in range(width):
            part = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
            value = np.where(k < have, mix(value * BASE + part), value)
    return value, ends
