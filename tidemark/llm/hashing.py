"""64-bit hashes of stretches of bytes, for many stretches at once, from sums over prefixes modulo 2**64."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hash with base and byte values from a seed; equal bytes have equal hashes at any place."""

    def __init__(self, seed: int):
        raw = hashlib.blake2b(b"rolling %d" % seed).digest()
        self.base = int.from_bytes(raw[:8], "little") | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = mix(np.arange(1, 257, dtype=U) * U(_ODD) + U(int.from_bytes(raw[8:16], "little")))
        self.powers = self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.base, U)]))
                self.inverses = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.inverse, U)]))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Sums over data[:i] for i from 0 to its length."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def stretches(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], spread; the length counts."""
        raw = (prefixes[ends] - prefixes[starts]) * self.inverses[starts]
        return mix(raw + (ends - starts).astype(U) * U(_ODD))

    def windows(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all data[i:i+size], spread."""
        n = len(prefixes) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((prefixes[size:] - prefixes[:n]) * self.inverses[:n] + U(size * _ODD % (1 << 64)))


def groups(offsets: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Rows first:last whose bytes are at most `most` together, or one row."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, min(last, n)))
        first = out[-1][1]
    return out
