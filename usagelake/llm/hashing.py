"""Vectorised 64-bit hashes of words and of runs of words, for tasks that work on whole batches.

No hash is a polynomial: modulo 2**64 these have the same value for whole families of words (Thue-Morse words), whatever the base. A word is the sum of
its bytes, each mixed with its place; a run of words is built by mixing halves, so each step is non-linear in both. Different seeds give
independent hashes.
"""

from __future__ import annotations

import numpy as np

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xD6E8FEB86659FD93)
_RIGHT = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_in_place(x: np.ndarray) -> None:
    """``mix`` with one more array of memory instead of several."""
    part = x >> np.uint64(30)
    x ^= part
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=part)
    x ^= part
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=part)
    x ^= part


_bytes: dict[int, np.ndarray] = {}


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the runs of bytes other than 0x20 and 0x09-0x0D."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words follow each other without overlap."""
    if seed not in _bytes:
        _bytes[seed] = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    small = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(int(lengths.sum()), dtype=small)
    place -= np.repeat(before.astype(small), lengths)
    at = np.repeat(starts.astype(small), lengths)
    at += place
    x = _bytes[seed][np.frombuffer(data, dtype=np.uint8)[at]]
    del at
    x += place.astype(np.uint64) * _PLACE
    del place
    _mix_in_place(x)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix((sums[before + lengths] - sums[before]) ^ lengths.astype(np.uint64))


class Runs:
    """Hashes of runs of ``words``: those of 2**j words are made of two halves, any other of the two such runs at its ends."""

    def __init__(self, words: np.ndarray):
        self._levels = [mix(words ^ _RIGHT)]

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _LEFT + mix(b + _RIGHT))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run words[start:end]."""
        n = (ends - starts).astype(np.int64)
        out = np.zeros(len(n), dtype=np.uint64)
        level = np.frexp(n)[1] - 1  # of the largest power of two up to n
        for j in np.unique(level[n > 0]).tolist():
            while len(self._levels) <= j:
                last, step = self._levels[-1], 1 << (len(self._levels) - 1)
                self._levels.append(self._joined(last[:-step], last[step:]))
            at = np.flatnonzero((level == j) & (n > 0))
            out[at] = self._joined(self._levels[j][starts[at]], self._levels[j][ends[at] - (1 << j)])
        return mix(out ^ n.astype(np.uint64))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run words[start:end]."""
    return Runs(words).hashes(starts, ends)
