"""Suffix arrays of one shard; plain numpy that runs inside tasks."""

from __future__ import annotations

import numpy as np


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros stand past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement: start from the order of eight bytes; double the depth by sorting, inside each group
    that is not yet single, on the group of the suffix that many places on."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    key = words8(data)
    # a suffix of under eight bytes comes before a longer one with the same padded bytes
    sa = np.lexsort((np.minimum(n - np.arange(n), 8), key)) if not data.all() else np.argsort(key, kind="stable")
    ordered, short = key[sa], np.minimum(n - sa, 8)
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (short[1:] != short[:-1])
    group = np.flatnonzero(first)[np.cumsum(first) - 1]
    rank = np.empty(n + 1, np.int64)
    rank[sa] = group + 1
    rank[n] = 0
    depth = 8
    while True:
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        open_at = np.flatnonzero(~(first & last))
        if not len(open_at):
            return sa
        suffix = sa[open_at]
        pair = rank[suffix] * (n + 2) + rank[np.minimum(suffix + depth, n)]
        order = np.argsort(pair, kind="stable")
        sa[open_at], pair = suffix[order], pair[order]
        begins = np.ones(len(pair), bool)
        begins[1:] = pair[1:] != pair[:-1]
        first[open_at] = begins
        rank[sa[open_at]] = open_at[begins][np.cumsum(begins) - 1] + 1
        depth *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: the prefix each suffix shares with the one before it in sa.

    In text order the value drops by one a step while the byte before both suffixes is equal, so only the places where
    it differs are compared, eight bytes at a time.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (before < 1) | (at == 0)
    fresh[1:] |= data[at[1:] - 1] != data[np.maximum(before[1:], 1) - 1]
    fresh[1:] |= before[:-1] < 0
    key = np.concatenate([words8(data), np.zeros(1, np.uint64)])
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    length = np.zeros(n, np.int64)
    live = np.arange(len(i))
    step = 0
    while len(live):
        a, b = i[live] + step, j[live] + step
        difference = key[np.minimum(a, n)] ^ key[np.minimum(b, n)]
        ended = (difference != 0) | (a >= n) | (b >= n)
        stop = live[ended]
        d = difference[ended]
        same = np.full(len(d), 8, np.int64)
        for k in range(8):
            same[(same == 8) & ((d >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0)] = k
        length[i[stop]] = np.minimum(step + same, n - np.maximum(i[stop], j[stop]))
        live = live[~ended]
        step += 8
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    plcp = np.maximum(length[source] - (at - source), 0)
    plcp[before < 0] = 0
    out[1:] = plcp[sa[1:]]
    return out


def repeated(data: np.ndarray, valid: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Which valid places start a string of `span` bytes that another valid place starts too, and one valid place of
    each distinct string."""
    out = np.zeros(len(data), bool)
    if not len(data):
        return out, np.empty(0, np.int64)
    sa = suffix_array(data)
    run = np.cumsum(common_prefixes(data, sa) < span) - 1
    out[sa] = np.bincount(run, weights=valid[sa])[run] >= 2
    places = np.flatnonzero(valid[sa])
    return out & valid, sa[places[np.unique(run[places], return_index=True)[1]]]


def in_several(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted arrays without repeats: which of each one's values another one has too. The arrays are merged one
    after the other, each by binary search in what was merged before."""
    merged = parts[0][:0]
    common = merged
    for part in parts:
        at = np.searchsorted(merged, part)
        met = np.zeros(len(part), bool)
        inside = at < len(merged)
        met[inside] = merged[at[inside]] == part[inside]
        common = np.concatenate([common, part[met]])
        merged = np.insert(merged, at[~met], part[~met])
    common = np.unique(common)
    return [common[np.minimum(np.searchsorted(common, p), len(common) - 1)] == p if len(common) else np.zeros(len(p), bool) for p in parts]
