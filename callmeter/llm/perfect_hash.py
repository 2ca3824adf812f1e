"""Minimal perfect hash of distinct 128-bit keys, in numpy.

Level by level, a key that is alone at its place of a bit array sets the bit there; the others go on to the next, smaller
level. A key's number is the rank of its bit, so that n keys have the numbers 0 to n-1, at some four bits a key.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
LOAD = 1.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (_mixed(hi + step) ^ _mixed(lo ^ step)) % np.uint64(size)


def build(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each level, and their words one level after the other. hi, lo: the halves of distinct keys, as uint64."""
    sizes, words = [], []
    while len(hi):
        size = -(-int(LOAD * len(hi) + 64) // 64) * 64
        at = _places(hi, lo, len(sizes), size)
        times = np.bincount(at.astype(np.int64), minlength=size)
        words.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = times[at] != 1
        hi, lo = hi[rest], lo[rest]
    return np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words])


def numbers(sizes: np.ndarray, words: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The number of each key; -1, or that of another key, for one that was not there."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    out, left, base = np.full(len(hi), -1), np.arange(len(hi)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _places(hi[left], lo[left], level, size) + np.uint64(base)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        here = (words[word] >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[here]] = (before[word] + below)[here]
        left, base = left[~here], base + size
    return out
