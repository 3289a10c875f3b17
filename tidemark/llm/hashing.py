"""Hashes of byte ranges, for many ranges at once.

A text's bytes c0 c1 ... get the prefix sums P[i] = sum of T[c_j] * M**j over j < i,
modulo 2**64, with a table T of random 64-bit values and an odd M. The hash of
bytes [s, e) is (P[e] - P[s]) * M**-s, mixed: equal bytes have equal hashes
wherever they start, and a range costs two look-ups whatever its length.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
STEP = 0x9E3779B97F4A7C15 | 1
STEP_INVERSE = pow(STEP, -1, 2**64)
_powers = {STEP: np.ones(1, np.uint64), STEP_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept by the worker and grown by doubling."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """P over 64-bit values, of length len(values) + 1."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(STEP, len(values)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ranges(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [starts, ends); ranges of different lengths do not compare by chance more often than others."""
    inverse = powers(STEP_INVERSE, len(p))
    return mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]
