"""Suffix arrays of byte buffers in numpy, and the longest common prefixes of their neighbours."""

from __future__ import annotations

import numpy as np

_PAD = 128


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` sorted by the bytes that follow, compared up to at least ``depth`` bytes.

    Larsson and Sadakane's refinement: places are first sorted by eight bytes, then groups of equal
    prefixes are split by the rank of what follows them, doubling the compared length each round;
    only groups of more than one place are touched again.  A place's rank is where its group begins.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    array = np.argsort(key, kind="stable")
    ordered = key[array]
    begins = np.append(True, ordered[1:] != ordered[:-1])
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank = np.full(n + 1, -1, dtype=np.int64)  # the end sorts before all
    rank[array] = start
    h = 8
    while h < depth:
        single = begins & np.append(begins[1:], True)
        open_ = np.flatnonzero(~single)  # places of the array, in runs of equal rank
        if not len(open_):
            break
        suffix = array[open_]
        group = rank[suffix]
        after = rank[np.minimum(suffix + h, n)]
        order = np.argsort(group * (n + 1) + after + 1, kind="stable")
        suffix, group, after = suffix[order], group[order], after[order]
        array[open_] = suffix
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        begins[open_] = new
        rank[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        h *= 2
    return array


def common_prefixes(data: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place of the suffix array: the length it has in common with the one before (first: 0).

    Kasai's observation, in text order: where both suffixes of a pair move on by one byte, the
    common length falls by one.  Only pairs that don't continue another are compared, eight bytes at
    a time, all such pairs at once.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)  # by text place: the suffix before it in the array
    before[array[1:]] = array[:-1]
    continues = np.append(False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0))
    own = np.flatnonzero(~continues & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    length = np.zeros(n, dtype=np.int64)
    active = own
    while len(active):
        p, q = active + length[active], before[active] + length[active]
        room = n - np.maximum(p, q)
        p, q = np.minimum(p, n), np.minimum(q, n)
        differ = eight[p] ^ eight[q]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        same = np.minimum(same, room)
        length[active] += same
        active = active[same == 8]
    run = np.maximum.accumulate(np.where(continues, 0, np.arange(n)))
    length = np.where(continues, np.maximum(length[run] - (np.arange(n) - run), 0), length)
    # a continued pair whose run began with nothing in common is compared on its own
    lost = np.flatnonzero(continues & (length == 0) & (length[run] < np.arange(n) - run))
    active = lost
    while len(active):
        p, q = active + length[active], before[active] + length[active]
        ok = (np.maximum(p, q) < n) & (data[np.minimum(p, n - 1)] == data[np.minimum(q, n - 1)])
        active = active[ok]
        length[active] += 1
    return length[array]
