"""A minimal perfect hash over pairs of 64-bit hashes, with arrays in the order of its slots.

Hash and displace: keys fall into buckets of a few; the largest buckets first, each gets the first displacement that sends
all its keys to free slots; a bucket of one key simply names a free slot. Everything is one integer array.
"""

from __future__ import annotations

import numpy as np

KEYS_PER_BUCKET = 4
#: Displacements tried at a time, and at most; beyond that the bucket's seed is changed and all begins anew.
TRIES, MOST_TRIES = 64, 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64; overflow is meant."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(h1: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(h1 + disp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _buckets(h1: np.ndarray, h2: np.ndarray, seed: int, b: int) -> np.ndarray:
    return (_mixed(h1 ^ (h2 << np.uint64(1)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(b)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(displacements, slot of each key)`` for distinct pairs; the first displacement is the seed."""
    n = len(h1)
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    b = n // KEYS_PER_BUCKET + 1
    for seed in range(1, 100):
        found = _place(h1, _buckets(h1, h2, seed, b), n, b)
        if found:
            return np.concatenate([[seed], found[0]]), found[1]
    raise ValueError("the pairs are not distinct")


def _place(h1: np.ndarray, bucket: np.ndarray, n: int, b: int) -> tuple[np.ndarray, np.ndarray] | None:
    disp, slot, free = np.zeros(b, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=b)
    ends = np.cumsum(sizes)
    by_size = np.argsort(-sizes, kind="stable")
    for k in by_size[: int((sizes > 1).sum())]:
        keys = order[ends[k] - sizes[k] : ends[k]]
        for first in range(0, MOST_TRIES, TRIES):
            d = np.arange(first, first + TRIES)
            at = _slots(h1[keys][None, :], d[:, None], n)
            good = free[at].all(axis=1)
            if len(keys) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                j = int(np.argmax(good))
                disp[k], slot[keys] = d[j], at[j]
                free[at[j]] = False
                break
        else:
            return None
    single = by_size[int((sizes > 1).sum()) : int((sizes > 0).sum())]
    rest = np.flatnonzero(free)[: len(single)]
    disp[single] = -1 - rest
    slot[order[ends[single] - 1]] = rest
    return disp, slot


def look_up(displacements: np.ndarray, n: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot of each pair; one that was not among the keys gets some slot, so its fingerprint must be compared."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    disp = displacements[1:][_buckets(h1, h2, int(displacements[0]), len(displacements) - 1)]
    return np.where(disp < 0, -1 - disp, _slots(h1, np.maximum(disp, 0), n))
