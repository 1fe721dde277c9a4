"""Vectorised 64-bit hashes of byte windows and word windows (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for every byte value.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash arrays."""
    x = a * M3
    x += b
    x ^= x >> np.uint64(31)
    x *= M1
    x ^= x >> np.uint64(30)
    return x


def window_hash(data: np.ndarray, log2: int) -> np.ndarray:
    """Hash of the 2**log2 bytes from each position on; shorter than data by 2**log2 - 1."""
    h = BYTE[data]
    for k in range(log2):
        h = pair(h[: -(1 << k)], h[1 << k :])
    return h


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over each window of width values; by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return op(x[:-rest], x[rest:]) if rest else x


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
