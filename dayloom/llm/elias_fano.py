"""Monotone sequences of integers in Elias-Fano form, read in slices from a mapped buffer.

A value of `low` low bits is split: the low bits stand packed one after another,
the high parts are written in unary as one bit vector, with the place of every
`SAMPLE`-th value noted. A sequence of n values up to u takes about
n * (2 + log2(u / n)) bits.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 4096
_HEADER = 4


def encode(values: np.ndarray) -> bytes:
    """Values in ascending order; the bytes have a multiple of eight."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    marks = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    unary = np.zeros((int(marks[-1]) + 64 if n else 0) // 64 * 64, np.uint8)
    unary[marks.astype(np.int64)] = 1
    samples = marks[::SAMPLE]
    packed = b"".join(_pack(values[at : at + SAMPLE], low) for at in range(0, n, SAMPLE))
    header = np.array([n, low, len(samples), len(unary) // 8], np.uint64)
    return b"".join([header.tobytes(), samples.tobytes(), np.packbits(unary, bitorder="little").tobytes(), packed])


def _pack(values: np.ndarray, low: int) -> bytes:
    """The low bits of one sample's values, in whole 8-byte words."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low].ravel()
    return np.packbits(np.append(bits, np.zeros(-len(bits) % 64, np.uint8)), bitorder="little").tobytes()


class Sequence:
    """A sequence that begins at a byte of a buffer; nothing is copied or decoded up front."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, samples, unary = (int(x) for x in np.frombuffer(buffer, np.uint64, _HEADER, at))
        at += 8 * _HEADER
        self.samples = np.frombuffer(buffer, np.uint64, samples, at)
        at += 8 * samples
        self.unary = np.frombuffer(buffer, np.uint8, unary, at)
        at += unary
        self.words = -(-SAMPLE * self.low // 64) * 8
        rest = self.n % SAMPLE
        size = self.n // SAMPLE * self.words + (-(-rest * self.low // 64) * 8 if rest else 0)
        self.packed = np.frombuffer(buffer, np.uint8, size, at)
        self.end = at + size

    def __len__(self) -> int:
        return self.n

    def block(self, number: int) -> np.ndarray:
        """The values of one sample, decoded."""
        begin = number * SAMPLE
        count = min(SAMPLE, self.n - begin)
        first = int(self.samples[number])
        end = int(self.samples[number + 1]) if number + 1 < len(self.samples) else 8 * len(self.unary)
        bits = np.unpackbits(self.unary[first // 8 : -(-end // 8)], bitorder="little")
        marks = np.flatnonzero(bits[first % 8 :])[:count] + first
        high = (marks - np.arange(begin, begin + count)).astype(np.uint64)
        if not self.low:
            return high
        raw = self.packed[number * self.words : number * self.words + self.words]
        rows = np.zeros((count, 64), np.uint8)
        rows[:, : self.low] = np.unpackbits(raw, bitorder="little")[: count * self.low].reshape(count, self.low)
        lows = np.packbits(rows, axis=1, bitorder="little").view(np.uint64).ravel()
        return high << np.uint64(self.low) | lows

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Values from `begin` to before `end`."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first = begin // SAMPLE
        parts = [self.block(b) for b in range(first, -(-end // SAMPLE))]
        return np.concatenate(parts)[begin - first * SAMPLE : end - first * SAMPLE]

    def successors(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending queries: the place of the first value not below each (n if none), and whether it is equal.

        Blocks are decoded one by one, only those in which a query falls.
        """
        places = np.full(len(queries), self.n, np.int64)
        equal = np.zeros(len(queries), bool)
        at = number = 0
        while at < len(queries) and number * SAMPLE < self.n:
            block = self.block(number)
            upto = at + int(np.searchsorted(queries[at:], block[-1], "right"))
            if upto > at:
                found = np.searchsorted(block, queries[at:upto])
                places[at:upto] = number * SAMPLE + found
                equal[at:upto] = block[found] == queries[at:upto]
                at = upto
            number = max(number + 1, self._block_of(queries[at]) if at < len(queries) else 0)
        return places, equal

    def _block_of(self, value: np.uint64) -> int:
        """The last block that begins at or below a value by its high part; earlier ones hold lower values only."""
        heads = self.samples - np.arange(0, self.n, SAMPLE, dtype=np.uint64)
        return max(0, int(np.searchsorted(heads, np.uint64(value) >> np.uint64(self.low), "left")) - 1)
