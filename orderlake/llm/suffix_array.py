"""Suffix arrays by the difference cover modulo 3 (Kärkkäinen and Sanders, 2003), in numpy.

Triples at positions 1 and 2 modulo 3 are sorted and named; where names repeat, the string
of names is sorted the same way. The other suffixes follow from one symbol and the rank
of what comes next, and both orders are merged by counting what lies before.
"""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows of non-negative numbers; equal rows share one."""
    rank = columns[0]
    for column in columns[1:]:
        width = int(column.max()) + 1
        if int(rank.max()) >= (1 << 62) // width:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * width + column
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of numbers from 1 up."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    pad = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    end = n + (n % 3 == 1)
    one, two, zero = np.arange(1, end, 3), np.arange(2, end, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    name = _names(pad[sample], pad[sample + 1], pad[sample + 2])
    if int(name.max()) + 1 < len(sample):
        order = suffix_array(name + 1)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name + 1
    width = len(sample) + 2
    key = pad[zero] * width + rank[zero + 1]
    by_key = np.argsort(key, kind="stable")
    zero = zero[by_key]
    before_one = np.searchsorted(np.sort(pad[one] * width + rank[one + 1]), key[by_key])
    pair = _names(np.concatenate([pad[zero], pad[two]]), np.concatenate([pad[zero + 1], pad[two + 1]]))
    long_key = pair * width + np.concatenate([rank[zero + 2], rank[two + 2]])
    before_two = np.searchsorted(np.sort(long_key[len(zero) :]), long_key[: len(zero)])
    out = np.empty(len(zero) + len(sample), np.int64)
    place = np.arange(len(zero)) + before_one + before_two
    out[place] = zero
    rest = np.ones(len(out), bool)
    rest[place] = False
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank[sample] - 1] = sample
    out[rest] = by_rank
    return out[out < n]


def equal_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in ``order``, each of at least ``length`` bytes: whether each begins as the one before it does."""
    if not len(order):
        return np.zeros(0, bool)
    word = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        word |= padded[k : k + len(data)] << np.uint64(8 * k)
    same = np.concatenate([[False], np.ones(len(order) - 1, bool)])
    if length < 8:
        for k in range(length):
            same[1:] &= data[order[1:] + k] == data[order[:-1] + k]
        return same
    for k in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = word[order[live] + k] == word[order[live - 1] + k]
    return same
