"""64-bit hashes of all byte strings of a text at once, in numpy.

A string's hash is a polynomial over its bytes, modulo 2**64, from prefix sums, put
through a finaliser.  Two different strings share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse; they grow by doubling."""
    for i, base in enumerate((_BASE, _BASE_INVERSE)):
        table = _tables[i]
        while len(table) <= n:
            step = np.array([pow(base, len(table), 1 << 64)], U)
            table = np.concatenate([table, table * step])
        _tables[i] = table
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over ``data`` (bytes)."""
    out = np.zeros(len(data) + 1, U)
    terms = data.astype(U)
    terms += U(1)
    terms *= _powers(len(data))[0][: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the strings from ``start`` to ``end``."""
    x = sums[end] - sums[start]
    x *= _powers(len(sums))[1][start]
    x += (end - start).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(x)


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all strings of ``k`` bytes."""
    x = sums[k:] - sums[:-k]
    x *= _powers(len(sums))[1][: len(x)]
    x += U(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix(x)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    x = keys[order]
    same = np.zeros(len(x) + 1, bool)
    np.equal(x[1:], x[:-1], out=same[1:-1]) if len(x) else None
    out = np.empty(len(x), bool)
    out[order] = same[1:] | same[:-1]
    return out
