"""Stretches of many texts at once, by arrays: where they are, a 64-bit hash of each, and values remembered by hash.

A stretch's hash is the sum of mixed code points times powers of an odd number; prefix sums give it for every stretch together.
"""

from __future__ import annotations

import numpy as np

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = base
        return np.multiply.accumulate(out)


def _mixed() -> np.ndarray:
    x = np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)
    with np.errstate(over="ignore"):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


class Hasher:
    def __init__(self):
        self.mixed = _mixed()
        self.up, self.down = _powers(_PRIME, 1), _powers(_INVERSE, 1)

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(codes):
            n = 1 << (len(codes) + 1).bit_length()
            self.up, self.down = _powers(_PRIME, n), _powers(_INVERSE, n)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(self.mixed[codes] * self.up[: len(codes)], out=sums[1:])
            # The length goes in, so that stretches of one letter's multiples can't meet.
            return (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Remembered:
    """Numbers by hash: lookups of many at once, in bounded memory."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.values[i], -1)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.values = both[order], np.concatenate([self.values, values])[order]

    def full(self, more: int) -> bool:
        return len(self.hashes) + more > self.most
