"""Hashed word shingles of whole texts, computed for a slice of texts at once.

Words are the runs of bytes other than blanks (0x20, 0x09-0x0D), with A-Z in lower case. A shingle is
SIZE consecutive words, or all words of a text that has fewer. Both are 64-bit hashes; a text's set
is sorted and distinct. A text without words has the empty set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .arrow import Slice

SIZE = 5
_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)]))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the bounds of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(_U)), np.searchsorted(s, bounds)


def sets(s: Slice, size: int = SIZE) -> Iterator[np.ndarray]:
    """The set of each text of a slice."""
    w, bounds = words(s.data, s.bounds)
    k = _U(0xD6E8FEB86659FD93)
    if len(w) >= size:
        all_ = w[: len(w) - size + 1].copy()
        for i in range(1, size):
            all_ = all_ * k + w[i : len(w) - size + 1 + i]
        all_ = mix(all_)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            u = np.sort(all_[a : b - size + 1])
            keep = np.empty(len(u), bool)
            keep[0] = True
            np.not_equal(u[1:], u[:-1], out=keep[1:])
            yield u[keep]
        elif b > a:
            one = w[a : a + 1].copy()
            for i in range(a + 1, b):
                one = one * k + w[i : i + 1]
            yield mix(one + _U(b - a))
        else:
            yield w[:0]


def digest(u: np.ndarray) -> bytes:
    """Texts with equal sets have equal digests."""
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()
