"""Content-defined anchors for strings of a fixed length.

Every window of `length` bytes is given to the leftmost least hash among its k-grams, its anchor.
That depends on the window's bytes alone, so equal windows have equal k-grams as anchors, at the
same offset. The windows of one anchor occurrence start in a row; the bytes they span are its cell.
All windows whose anchor has an offset in a certain range share a core of bytes around the anchor,
so a cell has something in common with another cell only if a core is equal too.
"""

from __future__ import annotations

import numpy as np

from .words import mix, powers

K = 24
RANGES = 4  # of anchor offsets, each with a core
PIECE = 1 << 20  # bytes of a text taken at a time, to bound memory
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def grams(b: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of the k bytes from each position, by doubling."""
    h, width, power = b.astype(np.uint64) + np.uint64(1), 1, _P
    done: np.ndarray | None = None
    have = 0
    left = k
    while left:
        if left & 1:
            if done is None:
                done, have = h, width
            else:  # done covers the first `have` bytes
                n = min(len(done), len(h) - have)
                done = done[:n] + h[have : have + n] * np.uint64(pow(_P, have, 1 << 64))
                have += width
        left >>= 1
        if left:
            h = h[:-width] + h[width:] * np.uint64(power)
            power, width = power * power & _MASK, 2 * width
    return done[: len(b) - k + 1]


def _extreme(h: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive values."""
    width = 1
    while 2 * width <= w:
        h = f(h[:-width], h[width:])
        width *= 2
    return f(h[: len(h) - (w - width)], h[w - width :]) if w > width else h


def ranges(length: int, k: int = K) -> list[tuple[int, int]]:
    """The ranges of anchor offsets in a window, ends inclusive."""
    cut = [round(i * (length - k + 1) / RANGES) for i in range(RANGES + 1)]
    return [(a, b - 1) for a, b in zip(cut, cut[1:], strict=False)]


def cell_type(length: int) -> np.dtype:
    return np.dtype([("anchor", "<u8"), ("cell", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("start", "<u4"), ("n", "<u2"), ("offset", "<u2"), ("cores", "<u4", (RANGES,))])


def cells(text: bytes, length: int, k: int = K) -> np.ndarray:
    """The cells of a text in order, doc and tag left 0; together they have all its windows.

    start, n: its windows; offset: of the anchor in the first one; cores: 0 where no window has such an offset.
    """
    parts = [_cells(text[at : at + PIECE + length - 1], at, length, k) for at in range(0, max(1, len(text) - length + 1), PIECE)]
    return np.concatenate(parts)


def _cells(text: bytes, at_byte: int, length: int, k: int) -> np.ndarray:
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) < length:
        return np.zeros(0, dtype=cell_type(length))
    g = mix(grams(b, k))
    w = length - k + 1
    least = _extreme(g, w, np.minimum)  # of each window
    edge = np.zeros(w - 1, dtype=np.uint64)
    chosen = np.flatnonzero(g == _extreme(np.concatenate([edge, least, edge]), w, np.maximum))  # least of some window, ties included
    n = len(least)
    # the leftmost chosen position from the window's start on that has the window's least hash
    mark = np.zeros(len(g) + 1, dtype=np.int32)
    mark[chosen + 1] = 1
    at = np.cumsum(mark[:n], dtype=np.int32)
    gc = g[chosen]
    wrong = np.flatnonzero(gc[at] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[gc[at[wrong]] != least[wrong]]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros(len(first), dtype=cell_type(length))
    count = np.diff(np.append(first, n))
    anchor = chosen[at[first]]
    power, inverse = powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])])
    string = lambda a, size: (sums[a + size] - sums[a]) * inverse[a]
    # the cell's hash: its bytes (covered by its first and last window), its length and where the anchor lies in it
    head, tail = string(first, length), string(first + count - 1, length)
    offset = anchor - first
    out["anchor"], out["start"], out["n"], out["offset"] = gc[at[first]], first + at_byte, count, offset
    out["cell"] = mix(mix(head) + mix(tail * np.uint64(3) + count.astype(np.uint64)) + offset.astype(np.uint64) * np.uint64(_P))
    for r, (low, high) in enumerate(ranges(length, k)):
        some = np.flatnonzero((offset >= low) & (offset - count + 1 <= high))
        core = mix(string(anchor[some] - np.minimum(low, offset[some]), length - (high - low)) + np.uint64(r))
        out["cores"][some, r] = (core >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out
