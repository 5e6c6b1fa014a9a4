"""Polynomial hashes of byte spans, vectorised: prefix sums modulo 2^64."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least; kept for later calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Spans:
    """Hashes of spans of bytes (or of wider numbers); equal spans have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        value = _BYTE[buf] if buf.dtype == np.uint8 else mixed(buf.astype(np.uint64) + _BYTE[0])
        np.cumsum(value * up[: len(buf)], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.down[low])

    def every(self, width: int) -> np.ndarray:
        """Hash of the span of width bytes from each start."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    black = (buf != 32) & ((buf < 9) | (buf > 13))
    edge = np.diff(np.concatenate(([False], black, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
