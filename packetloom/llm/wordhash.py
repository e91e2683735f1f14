"""Vectorised 64-bit hashes of the words of many texts at once, and of parts of words.

A polynomial over bytes modulo 2**64 with prefix sums gives the hash of any byte range in O(1), so
numpy hashes all words of a block without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd multiplier and its inverse modulo 2**64, and the multipliers of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


class RangeHash:
    """Hashes of byte ranges of one buffer; equal bytes have equal hashes wherever they stand."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _table(cls, n: int) -> None:
        if len(cls._powers) <= n:
            size = max(n + 1, 1 << 20)
            for name, base in (("_powers", BASE), ("_inverse", BASE_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        self._table(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * self._powers[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._inverse[starts] + ends.astype(np.uint64) - starts.astype(np.uint64))


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, their bytes joined by line feeds, where each starts and where the last ends), some ``size`` bytes a block.

    A longer text is a block of its own: texts are never cut.
    """
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j]) + 1
            j += 1
        starts = np.zeros(j - i + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts[i:j]], out=starts[1:])
        yield i, j, np.frombuffer(b"\n".join(texts[i:j]) + b"\n", dtype=np.uint8), starts
        i = j
