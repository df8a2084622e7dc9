"""Fingerprints of spans of text from running sums, and a compact membership filter of them.

A span's fingerprint is two 64-bit values of its code points: a polynomial each, taken as the difference of two
running sums, so that any span of a text costs the same whatever its length. 128 bits leave no collision to
expect among 10**12 spans and 10**9 keys (under 1e-17).
"""

from __future__ import annotations

import numpy as np

#: Parameters: two odd multipliers.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n at least."""
    known = _tables.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n, 1 << 16) + 1
        both = (base, pow(base, -1, 1 << 64))
        known = _tables[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in both)
    return known


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, where each text starts, and the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


class Spans:
    """Running sums of some code points."""

    def __init__(self, points: np.ndarray):
        x = _mixed(points.astype(np.uint64) + np.uint64(1))
        self.sums = []
        for base in BASES:
            sums = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(x * _powers(base, len(x))[0][: len(x)], out=sums[1:])
            self.sums.append(sums)

    def begun(self, which: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ended() needs of the starts of spans, whose ends may be many."""
        return self.sums[which][starts], _powers(BASES[which], len(self.sums[which]))[1][starts]

    def ended(self, which: int, begun: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[which][ends] - begun[0]) * begun[1] + (ends - starts).astype(np.uint64)).view(np.int64)

    def part(self, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One value of the fingerprints of points[start:end], int64."""
        return self.ended(which, self.begun(which, starts), starts, ends)

    def prints(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of points[start:end], as two int64 arrays."""
        return self.part(0, starts, ends), self.part(1, starts, ends)


def turned(lo: np.ndarray, k: int) -> np.ndarray:
    """Values of fingerprints for the filter k of a row of filters, which are to err independently."""
    return _mixed(lo.view(np.uint64) + np.uint64(k + 1) * np.uint64(0x632BE59BD9B4E019)).view(np.int64)


class Filter:
    """Bits of a set of 64-bit values: whatever is in the set is found, and little else. The bits of a value are in one word."""

    PROBES = 3

    def __init__(self, words: np.ndarray):
        self.words = words  # uint64, a power of two of them

    @staticmethod
    def size(keys: int, most_bytes: int) -> int:
        """Words for so many keys: 16 bits or more each, as long as that is within most_bytes."""
        words = 1
        while words * 64 < 16 * keys and words * 16 <= most_bytes:
            words *= 2
        return words

    @staticmethod
    def place(values: np.ndarray, probe: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bit in it) of a probe of each value."""
        v = values.view(np.uint64)
        word = (v >> np.uint64(6 * Filter.PROBES)) & np.uint64(words - 1)
        return word.view(np.int64), np.uint64(1) << ((v >> np.uint64(6 * probe)) & np.uint64(63))

    @staticmethod
    def bits(values: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, all bits in it) of each value."""
        word, bits = Filter.place(values, 0, words)
        for probe in range(1, Filter.PROBES):
            bits |= Filter.place(values, probe, words)[1]
        return word, bits

    def found(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that are in the set, and of few others."""
        word, bits = self.bits(values, len(self.words))
        return np.flatnonzero((self.words[word] & bits) == bits)
