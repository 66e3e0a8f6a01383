"""Word shingles of a text as hashed sets; plain functions that run inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from ledgerline.llm.common import held

WIDTH = 5
#: Word hashes kept at a time in a worker.
CACHE = 1 << 19


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h



def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; A-Z count as a-z, words are parted by ASCII space.

    With fewer words, the whole sequence is the one run; without words, the set is empty.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(held("shingles", _WordHash).__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = codes[:n].copy()
    for j in range(1, width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return np.unique(_mixed(h))


def min_hashes(values: np.ndarray, multipliers: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The least value of each multiply-mix hash over the set."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), block):
        x = values[None, at : at + block] * multipliers[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for non-empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
