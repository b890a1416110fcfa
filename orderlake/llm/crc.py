"""CRC-32 of a part of a byte string from the CRC-32 of its prefixes."""

from __future__ import annotations

import zlib

import numpy as np


def _byte_step() -> np.ndarray:
    """What one zero byte after a string does to each bit of its CRC, without the final inversion."""
    out = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return np.array(out, np.uint32)


def _tables(columns: np.ndarray) -> np.ndarray:
    """The linear map with these columns, as four tables by byte."""
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit) & 1 == 1
            out[place, has] ^= columns[8 * place + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for place in range(4):
        out ^= tables[place][(x >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def _doublings(n: int = 48) -> list[np.ndarray]:
    columns, out = _byte_step(), []
    for _ in range(n):
        out.append(_tables(columns))
        columns = _apply(out[-1], columns)
    return out


_STEPS = _doublings()


def part(before: np.ndarray, through: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of the ``length`` bytes between two prefixes, whose CRCs are ``before`` and ``through``."""
    moved = before.astype(np.uint32)
    for k, tables in enumerate(_STEPS):
        on = (length >> k) & 1 == 1
        if on.any():
            moved[on] = _apply(tables, moved[on])
        elif not (length >> k).any():
            break
    return moved ^ through.astype(np.uint32)


def prefixes(data: bytes, block: int) -> list[int]:
    """CRCs of the prefixes of 0, ``block``, 2 ``block``, … bytes and of all."""
    out, crc = [0], 0
    for i in range(0, len(data), block):
        crc = zlib.crc32(data[i : i + block], crc)
        out.append(crc)
    return out
