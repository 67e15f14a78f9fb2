"""Gray-order hierarchical index over bit fingerprints (numpy kernel of the SimHash join).

Fingerprints are rows of ``(n, lanes)`` uint64. Sorted by Gray rank, neighbours differ in few bits, so a run
of consecutive rows agrees on many bit positions. A node holds the positions on which all its rows agree (a
mask) and their values (a pattern); upper nodes hold what all their children share. Two nodes differ at least
in the positions that both masks cover and the patterns contradict, and a child only adds the positions that
its parent did not cover: differences are accumulated on the way down and whole groups are pruned as soon as
they exceed the limit.

One tree spans all buckets of a chunk: rows are sorted by bucket, then by Gray rank, a node knows its first and last
bucket, and two nodes without a bucket in common are pruned before any bit is looked at. Every pair goes through the
tree, whatever the size of its bucket.
"""

from __future__ import annotations

import numpy as np

FAN = 8
_SLICE = 4096


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Rank of each row in the Gray sequence, as big-endian lanes of uint64."""
    out = np.empty_like(fp)
    carry = np.zeros(len(fp), dtype=np.uint64)
    for lane in range(fp.shape[1]):
        x = fp[:, lane].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        x ^= carry * np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, lane] = x
        carry = x & np.uint64(1)
    return out


def gray_order(fp: np.ndarray, *major: np.ndarray) -> np.ndarray:
    """Order by the major keys, then by Gray rank."""
    rank = gray_rank(fp)
    return np.lexsort((*[rank[:, k] for k in range(rank.shape[1] - 1, -1, -1)], *major[::-1]))


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def _levels(fp: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(pattern, mask, first bucket, last bucket)`` of the nodes of each level, the root first and the rows last."""
    low, high, first, last = fp, fp, bucket, bucket
    levels = [(fp, np.full_like(fp, 0xFFFFFFFFFFFFFFFF), bucket, bucket)]
    while len(low) > 1:
        at = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, at, axis=0), np.bitwise_or.reduceat(high, at, axis=0)
        first, last = first[at], last[np.minimum(at + FAN, len(last)) - 1]
        levels.append((low, ~(low ^ high), first, last))
    return levels[::-1]


def near_pairs(fp: np.ndarray, bucket: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one bucket that differ in at most ``limit`` bits.

    Rows of a bucket stand together, in Gray order, and buckets ascend. Returns row numbers ``(i, j)``.
    """
    if len(fp) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    levels = _levels(fp, bucket)
    fan = np.arange(FAN)
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32))]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while stack:
        depth, a, b, acc = stack.pop()
        if len(a) > _SLICE:
            stack += [(depth, a[k : k + _SLICE], b[k : k + _SLICE], acc[k : k + _SLICE]) for k in range(0, len(a), _SLICE)]
            continue
        if depth == len(levels) - 1:
            found.append((a, b))
            continue
        _, mask, _, _ = levels[depth]
        below, inner, first, last = levels[depth + 1]
        ca = np.repeat(a[:, None] * FAN + fan, FAN, axis=1).ravel()
        cb = np.tile(b[:, None] * FAN + fan, (1, FAN)).ravel()
        parent = np.repeat(np.arange(len(a)), FAN * FAN)
        keep = (ca < len(below)) & (cb < len(below)) & ((ca < cb) if depth + 2 == len(levels) else (ca <= cb))
        ca, cb, parent = ca[keep], cb[keep], parent[keep]
        meet = last[ca] >= first[cb]
        ca, cb, parent = ca[meet], cb[meet], parent[meet]
        fresh = inner[ca] & inner[cb] & ~(mask[a] & mask[b])[parent]
        total = acc[parent] + _distance((below[ca] ^ below[cb]) & fresh)
        near = total <= limit
        if near.any():
            stack.append((depth + 1, ca[near], cb[near], total[near]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n rows: the smallest row number linked to it."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label
