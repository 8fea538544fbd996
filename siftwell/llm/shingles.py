"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of anything but the six ASCII white-space characters, in lower case (A-Z).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    def __init__(self, words: int, chunk: int = 1 << 20):
        self.words, self.chunk = words, chunk
        self.power = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, self.chunk + 1)
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                out = np.full(n, base, _U)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def words_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each text and the end the index of its first word."""
        joined = b"\n".join(texts).lower() + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        self._grow(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, _U)
        np.cumsum((buf.astype(_U) + _U(1)) * self.power[: len(buf)], out=sums[1:])
        word = np.concatenate(([False], ~_SPACE[buf], [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        hashes = mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return hashes, np.searchsorted(start, begins)

    def chunks(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(index of the first text, hashes of words, hashes of shingles, indices of the texts' first words and the end). Shingles
        go on over the ends of texts."""
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) < self.chunk:
                size += len(texts[hi])
                hi += 1
            hashes, first = self.words_of(texts[lo:hi])
            k = self.words
            rows = hashes.copy()
            n = max(0, len(rows) - k + 1)
            rows = rows[:n]
            for j in range(1, k):
                rows = mix64(rows * _U(0x2545F4914F6CDD1D) + hashes[j : j + n])
            yield lo, hashes, rows, first
            lo = hi

    def sequences(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the text, hashes of its shingles in order). Fewer words than a shingle has: all of them are one."""
        k = self.words
        for lo, hashes, rows, first in self.chunks(texts):
            for i in range(lo, lo + len(first) - 1):
                a, b = int(first[i - lo]), int(first[i - lo + 1])
                if b - a >= k:
                    yield i, rows[a : b - k + 1]
                elif b > a:
                    short = hashes[a : a + 1]
                    for j in range(a + 1, b):
                        short = mix64(short * _U(0x2545F4914F6CDD1D) + hashes[j : j + 1])
                    yield i, mix64(short + _U(b - a))
                else:
                    yield i, rows[:0]


def shingle_set(text: bytes, words: int) -> set[bytes]:
    """The distinct shingles themselves."""
    w = text.lower().split()
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    parts = [w[i:] for i in range(words)]
    return set(map(b" ".join, zip(*parts)))  # noqa: B905  the shortest ends it
