"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCATTER = np.uint32(0x9E3779B1)


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and all white space as one kind."""
    out = _LOWER[data]
    out[(out >= 9) & (out <= 13)] = 32
    return out


def hashed(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of `bits` bits for the n bytes from each position (len(data) - n + 1 of them)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint32)
    value = np.full(m, n, dtype=np.uint32)
    for k in range(n):
        value = value * np.uint32(0x01000193) + data[k : k + m]
    value ^= value >> np.uint32(15)
    return (value * _SCATTER) >> np.uint32(32 - bits)


def inside(limits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions of n-grams that lie in one text, for texts end to end."""
    past = np.zeros(size + 1, dtype=np.int32)
    np.add.at(past, np.maximum(limits[:-1], limits[1:] - n + 1), 1)
    np.add.at(past, limits[1:], -1)
    return np.flatnonzero(np.cumsum(past)[: max(size - n + 1, 0)] == 0)
