"""Words and their hashes straight from UTF-8 bytes, in numpy, for many documents at once.

The hash of a byte range is a polynomial in an odd base modulo 2**64, taken from prefix sums, so that the hash
of any range costs two lookups. Prefix sums are kept at the asked positions only: memory is a fixed block plus
some bytes a word, however long the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for ranges whose starts and ends both ascend."""
    totals = []
    for positions in (starts, ends):
        totals.append(np.zeros(len(positions), np.uint64))
    carry, scale = np.uint64(0), 1
    factor = pow(_BASE, _BLOCK, 1 << 64)
    cuts = [np.searchsorted(p, np.arange(0, len(data) + _BLOCK, _BLOCK), side="right") for p in (starts, ends)]
    for k, at in enumerate(range(0, len(data), _BLOCK)):
        block = data[at : at + _BLOCK]
        sums = np.cumsum(_BYTES[block] * _POWER[: len(block)], dtype=np.uint64) * np.uint64(scale) + carry
        for positions, total, cut in zip((starts, ends), totals, cuts):
            lo, hi = cut[k], cut[k + 1]  # positions in (at, at + _BLOCK]
            total[lo:hi] = sums[positions[lo:hi] - at - 1]
        carry, scale = sums[-1], scale * factor % (1 << 64)
    high = np.array([pow(_BASE, -_BLOCK * k, 1 << 64) for k in range(len(data) // _BLOCK + 1)], np.uint64)
    undo = _INVERSE[starts % _BLOCK] * high[starts // _BLOCK]
    return mix((totals[1] - totals[0]) * undo + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of several documents in order: byte range, document index and hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All maximal runs of bytes other than space and tab to carriage return, none across documents."""
    inside = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[: len(data)] = inside
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, doc, range_hashes(data, starts, ends))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of words i to i + n - 1, whether they are in one document) for each i."""
    count = max(0, len(words.hash) - n + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(_BASE) + words.hash[k : k + count]
    same = words.doc[:count] == words.doc[n - 1 :][:count]
    return mix(rolled), same
