"""Vectorised character and word hashing for the tasks that run in Python."""

from __future__ import annotations

import functools

import numpy as np

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=None)
def char_table(kind: str) -> np.ndarray:
    """Per code point: is it a letter (``alpha``), or a letter or digit (``alnum``)?"""
    test = str.isalpha if kind == "alpha" else str.isalnum
    return np.fromiter((test(chr(c)) for c in range(0x110000)), dtype=bool, count=0x110000)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Powers:
    """Growing table of powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.base, self.inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            self.up = np.concatenate([self.up, self.up * (self.up[-1:] * self.base)])
            self.down = np.concatenate([self.down, self.down * (self.down[-1:] * self.inverse)])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word (run of letters and digits) of the lower-cased text, in order.

    A text without such a run is cut at its white space instead.
    """
    codes = codepoints(text.lower())
    inside = char_table("alnum")[codes]
    if not inside.any():
        inside = np.fromiter((not chr(c).isspace() for c in codes), dtype=bool, count=len(codes))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = POWERS.upto(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
