"""Arrow text columns as flat byte arrays, for numpy inside Spark tasks.

A word is ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty. All helpers work on
whole texts; a batch is only cut between rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1 << 12, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers[:n]


_powers[1:] = np.multiply.accumulate(np.full(len(_powers) - 1, _BASE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each row begins (one more entry than rows)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class Keys:
    """Hash functions of one run, drawn from a secret seed: nobody can write two texts that meet in them.

    Ranges of up to ``SHORT`` bytes and windows of that many values go through a polynomial modulo 2**64 whose base and
    byte values are secret. For that modulus long ranges can be made equal whatever the base, so these go through a keyed
    cryptographic hash.
    """

    SHORT = 64

    def __init__(self, seed: bytes):
        self.seed = seed
        random = np.random.default_rng(np.frombuffer(hashlib.blake2b(seed).digest(), np.uint32))
        self.byte = random.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = random.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grown(self, known: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
        if len(known) >= n:
            return known
        steps = np.full(max(n, 1 << 12), factor, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def powers(self, n: int) -> np.ndarray:
        self._powers = self._grown(self._powers, n, self.base)
        return self._powers[:n]

    def inverse_powers(self, n: int) -> np.ndarray:
        self._inverses = self._grown(self._inverses, n, np.uint64(pow(int(self.base), -1, 2**64)))
        return self._inverses[:n]

    def rolling(self, values: np.ndarray, size: int, part: int = 1 << 17) -> np.ndarray:
        """A hash of every ``size`` consecutive values."""
        n = max(0, len(values) - size + 1)
        out = np.empty(n, np.uint64)
        for low in range(0, n, part):
            some = values[low : low + part + size - 1]
            total = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(some * self.powers(len(some)), out=total[1:])
            high = min(n, low + part)
            out[low:high] = mix((total[size:] - total[:-size]) * self.inverse_powers(high - low))
        return out

    def windows(self, values: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive values of one row, and the index each window starts at."""
        found = self.rolling(values, size)
        start = np.flatnonzero(row[: len(found)] == row[size - 1 :]) if len(found) else np.zeros(0, np.int64)
        return found[start], start

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, part: int = 1 << 18) -> np.ndarray:
        """Hashes of ranges of bytes."""
        length = end - start
        out = np.empty(len(start), np.uint64)
        short = np.flatnonzero(length <= self.SHORT)
        sums = np.concatenate([[0], np.cumsum(length[short])])
        at = 0
        while at < len(short):
            stop = max(at + 1, int(np.searchsorted(sums, sums[at] + part, side="right")) - 1)
            some, size = short[at:stop], length[short[at:stop]]
            head = sums[at:stop] - sums[at]
            within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(head, size)
            values = self.byte[data[np.repeat(start[some], size) + within]] * self.powers(self.SHORT)[within]
            full = size > 0
            found = np.zeros(len(some), np.uint64)
            if full.any():
                found[full] = np.add.reduceat(values, head[full])
            out[some] = mix(found + size.astype(np.uint64) * self.base)
            at = stop
        long = np.flatnonzero(length > self.SHORT)
        if len(long):
            digest = lambda a, b: hashlib.blake2b(data[a:b], digest_size=8, key=self.seed).digest()
            made = b"".join([digest(a, b) for a, b in zip(start[long].tolist(), end[long].tolist())])
            out[long] = np.frombuffer(made, np.uint64)
        return out


def new_seed() -> bytes:
    """A seed for the tasks of one run; drawn once, so that a repeated task hashes as before."""
    return secrets.token_bytes(16)


@lru_cache(maxsize=4)
def keys_of(seed: bytes) -> Keys:
    return Keys(seed)


class Words:
    """Where the words of a batch are: ``start``, ``end`` (bytes), ``row``, and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        rows = len(at) - 1
        self.solid = solid = ~_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        heads = at[:-1][at[:-1] < len(data)]
        begin[heads] = solid[heads]
        self.start = np.flatnonzero(begin)
        stop = solid.copy()
        stop[:-1] &= begin[1:] | ~solid[1:]
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)

    def hashes(self, keys: Keys | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the same in every run without keys."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if keys:
            return keys.ranges(self.data, self.start, self.end)
        length = self.end - self.start
        head = np.concatenate([[0], np.cumsum(length)[:-1]])
        within = np.arange(int(length.sum())) - np.repeat(head, length)
        values = _BYTE[self.data[self.solid]] * powers(int(length.max()) + 1)[within]
        return mix(np.add.reduceat(values, head) + length.astype(np.uint64) * _BASE)

    def take(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some words."""
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_inverses = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        steps = np.full(max(n, 1 << 12), _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _inverses = np.multiply.accumulate(steps)
    return _inverses[:n]


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return mix((total[size:] - total[:-size]) * _inverse_powers(n))


def windows(values: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive values of one row, and the index each window starts at."""
    found = rolling(values, size)
    start = np.flatnonzero(row[: len(found)] == row[size - 1 :]) if len(found) else np.zeros(0, np.int64)
    return found[start], start


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def first_mask(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: its group among equal (row, key), and the groups' sizes."""
    both = mix(key + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, group, sizes = np.unique(both, return_inverse=True, return_counts=True)
    return group, sizes
