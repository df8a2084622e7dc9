"""Vectorised word and shingle hashes of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1
_tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """_P ** i and its inverse modulo 2 ** 64 for i up to n at least."""
    if len(_tables[0]) <= n:
        for k, p in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            _tables[k] = np.append(np.uint64(1), np.cumprod(np.full(max(n, 1 << 16), p, dtype=np.uint64)))
    return _tables


def _string_hashes(b: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of b[head:end]: differences of one running sum, brought to the same power."""
    power, inverse = powers(len(b))
    sums = np.empty(len(b) + 1, dtype=np.uint64)
    sums[0] = 0
    x = b.astype(np.uint64)
    x += np.uint64(1)
    x *= power[: len(b)]
    np.cumsum(x, out=sums[1:])
    return mix((sums[ends] - sums[heads]) * inverse[heads] + (ends - heads).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space) of text, in order."""
    b = np.frombuffer(text, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    kept = np.flatnonzero(~space)
    if not len(kept):
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(first[kept])
    return _string_hashes(b[kept], starts, np.append(starts[1:], len(kept)))


def column_words(texts, delete: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of a binary Arrow column, number of words of each text): as word_hashes of each text, lower-cased
    (ASCII) and without the bytes to delete, but a whole column at a time. Nulls have no words."""
    n = len(texts)
    if n > 256:  # running sums of moderate length
        parts = [column_words(texts.slice(at, 256), delete) for at in range(0, n, 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
    if not n or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    b = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    gone = np.zeros(256, dtype=bool)
    gone[list(delete)] = True
    space = _SPACE[b]
    step = space.astype(np.int8)
    filled = starts[starts < len(b)]
    step[filled] = 1  # a text's first byte, or the space there, divides words too
    kept = np.flatnonzero(~space & ~gone[b])
    if not len(kept):
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    part = np.cumsum(step, dtype=np.int32)[kept]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    counts = np.diff(np.searchsorted(kept[heads], np.append(starts, len(b))))
    return _string_hashes(lower[b[kept]], heads, np.append(heads[1:], len(kept))), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of `width` consecutive words; of all words if there are fewer; none if there are none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * _P + words[k : k + n]
    return mix(h + np.uint64(width))
