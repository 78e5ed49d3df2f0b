"""Hashes of many substrings at once, by prefix sums modulo 2 to the 64."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd base and its inverse, and random weights of the byte values.
BASE = 0x9E6C63D0876A9A47 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WEIGHT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), kept for the longest text so far."""
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U(base), dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[name] = out
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits, one to one."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i]: the weighted sum of the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(WEIGHT[data] * powers(BASE, len(data)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each substring [start, end), the same wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the substring of this size at each place."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[size:] - sums[:n]) * powers(INVERSE, n))
