"""Rolling hashes and winnowing over one text, vectorised; shared by the leak and the shared-span operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        m = max(n + 1, 2 * len(_powers[0]))
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, b & (2**64 - 1), np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash for each of the text's k-grams of code points; none if the text is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _upto(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes + np.uint64(1)) * power[: len(codes)], dtype=np.uint64, out=total[1:])
    return _mix((total[k:] - total[:-k]) * inverse[:n])


def winnow(text: str, k: int, w: int, ranked: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest k-gram of each run of w (the last of equal ones), or of the first by `ranked`.

    Two texts with at least k + w - 1 characters in common share a kept gram, if both rank alike. A text with fewer than w
    grams keeps its smallest.
    """
    h = gram_hashes(text, k)
    if not len(h):
        return np.empty(0, np.int64), h
    order = h if ranked is None else ranked(h)
    if len(h) <= w:
        at = np.array([len(h) - 1 - int(order[::-1].argmin())])
    else:
        runs = np.lib.stride_tricks.sliding_window_view(order, w)
        at = np.unique(np.arange(len(runs)) + w - 1 - runs[:, ::-1].argmin(axis=1))
    return at.astype(np.int64), h[at]
