"""Word shingles of whole slices of text at once, as 64-bit hashes (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (published constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order; words end at white space and at the ends of rows."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ink = ~_SPACE[data]
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1]
    closes[:-1] &= ~ink[1:]
    inner = at[(at > 0) & (at < len(data))]
    opens[inner] |= ink[inner]
    closes[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, back = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashed = _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _PLACE[63])
    return hashed, np.searchsorted(at, start, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; fewer words than ``width`` make one shingle, none make none."""
    hashed, row = words(data, at)
    rows = len(at) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    n = len(hashed) - width + 1
    if n > 0:
        rolled = hashed[:n] * _PLACE[0]
        for k in range(1, width):
            rolled = rolled + hashed[k : k + n] * _PLACE[k]
        rolled = _mix(rolled)
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = np.append(hashed[a:b] * _PLACE[: b - a], _PLACE[32 + b - a])
            out.append(_mix(few.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
