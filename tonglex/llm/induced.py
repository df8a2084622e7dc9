"""Suffix sorting by external induction with common-prefix values, cut at a depth.

S*-suffixes (the starts of rising stretches after falling ones) are ranked through a reduced
string: names of S*-substrings, doubled until they cover the depth. All other suffixes are induced:
L-suffixes in rising and S-suffixes in falling order. The priority queue of the induction is a
queue per first character, since what a sweep inserts under one character is in order already.
Queues hold tuples (position, common prefix with the tuple before) and go to an unlinked
temporary file beyond a set amount of memory. A suffix's common prefix with its predecessor is one
more than the least value between the suffixes that induced the two.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 18  # tuples taken from a queue at once
Batch = tuple[np.ndarray, np.ndarray]  # positions (uint32), common prefixes (uint8)


class Spool:
    """Chunks of tuples, in memory up to a limit and in one temporary file beyond it."""

    def __init__(self, memory: int):
        self.free, self.file = memory, None

    def put(self, pos: np.ndarray, lcp: np.ndarray):
        size = 5 * len(pos)
        if size <= self.free:
            self.free -= size
            return pos, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induced-")
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(pos).tobytes())
        self.file.write(np.ascontiguousarray(lcp).tobytes())
        return at, len(pos)

    @staticmethod
    def upto(chunks: list, at: int) -> int:
        """End of a run of chunks from `at` on with at most BATCH tuples, or of one chunk."""
        size, end = 0, at
        while end < len(chunks) and (end == at or size < BATCH):
            size += len(chunks[end][0]) if isinstance(chunks[end][0], np.ndarray) else chunks[end][1]
            end += 1
        return end

    def get(self, chunk, last: bool = False) -> Batch:
        """The chunk's tuples; last: they are not needed again."""
        if isinstance(chunk[0], np.ndarray):
            if last:
                self.free += 5 * len(chunk[0])
            return chunk
        at, n = chunk
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), dtype=np.uint32), np.frombuffer(self.file.read(n), dtype=np.uint8)

    def joined(self, chunks: list) -> Batch:
        got = [self.get(c, last=True) for c in chunks]
        return got[0] if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is S, last position of each one's run of equal characters)."""
    n = len(t)
    end = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.uint32), np.uint32(n - 1))
    end = np.append(np.minimum.accumulate(end[::-1])[::-1], np.uint32(n - 1)).astype(np.uint32)
    up = np.append(t[:-1] < t[1:], True)
    return up[end], end


def _refined(rank: np.ndarray, sub: np.ndarray, key: np.ndarray) -> None:
    """Split the classes of the members `sub`, which are whole, by key; a rank is the number of smaller members."""
    order = np.lexsort((key, rank[sub]))
    r, k = rank[sub][order], key[order]
    new_class = np.concatenate([[True], r[1:] != r[:-1]])
    new = new_class | np.concatenate([[True], k[1:] != k[:-1]])
    at = np.arange(len(r))
    start = np.maximum.accumulate(np.where(new, at, 0))
    base = np.maximum.accumulate(np.where(new_class, at, 0))
    rank[sub[order]] = r + (start - base)


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _sorted_stars(t: np.ndarray, is_s: np.ndarray, depth: int) -> Batch:
    """S*-suffixes in order of their first `depth` characters, with common prefixes up to depth."""
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    m = len(stars)
    size = np.diff(np.append(stars, len(t) - 1)) + 1
    symbols = np.concatenate([2 * t.astype(np.uint16) + is_s + 1, np.zeros(8, dtype=np.uint16)])

    def word(rows: np.ndarray, w: int) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for j in range(6 * w, 6 * w + 6):
            c = symbols[np.minimum(stars[rows] + j, len(symbols) - 1)].astype(np.uint64)
            out = (out << np.uint64(10)) | np.where(j < size[rows], c, np.uint64(0))
        return out

    rank = np.zeros(m, dtype=np.int64)
    _refined(rank, np.arange(m), word(np.arange(m), 0))
    w = 1
    while (size > 6 * w).any():
        longer = np.zeros(m, dtype=bool)
        longer[rank[size > 6 * w]] = True
        sub = np.flatnonzero(longer[rank])
        _refined(rank, sub, word(sub, w))
        w += 1
    k = 1  # names; each spans two characters at least
    while 2 * k < depth + 2:
        sub = _tied(rank)
        if not len(sub):
            break
        after = sub + k
        _refined(rank, sub, np.where(after < m, rank[np.minimum(after, m - 1)], -1))
        k *= 2
    order = np.argsort(rank, kind="stable")
    pos = stars[order]
    lcp = np.zeros(m, dtype=np.uint8)
    same = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])
    lcp[same] = depth
    live = np.flatnonzero(~same[1:]) + 1
    for d in range(depth):
        a, b = pos[live] + d, pos[live - 1] + d
        ok = (a < len(t)) & (b < len(t))
        live = live[ok][t[a[ok]] == t[b[ok]]]
        if not len(live):
            break
        lcp[live] = d + 1
    return pos.astype(np.uint32), lcp


class _Sweep:
    """One induction: takes suffixes in sweep order, puts those they induce into the queues of their first characters."""

    def __init__(self, t: np.ndarray, is_s: np.ndarray, kind: bool, depth: int, spool: Spool):
        self.t, self.is_s, self.kind, self.depth, self.spool = t, is_s, kind, depth, spool
        self.queues: list[list] = [[] for _ in range(256)]
        self.since = np.zeros(256, dtype=np.uint8)  # least common prefix since the last insertion
        self.last = np.zeros(256, dtype=np.int64) - 1

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        m = len(pos)
        before = np.maximum(pos, 1) - np.uint32(1)
        sel = np.flatnonzero((self.is_s[before] == self.kind) & (pos > 0))
        low = lcp.min()
        if not len(sel):
            np.minimum(self.since, low, out=self.since)
            return
        prev = before[sel]
        char = self.t[prev]
        order = np.argsort(char, kind="stable")
        s, prev, char = sel[order], prev[order], char[order]
        first = np.concatenate([[True], char[1:] != char[:-1]])
        heads = np.flatnonzero(first)
        val = np.empty(len(s), dtype=np.uint8)
        if len(heads) < len(s):
            rest = np.flatnonzero(~first)
            span = np.stack([s[rest - 1] + 1, s[rest] + 1], axis=1).ravel()
            val[rest] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), span)[::2]
        bs = char[heads]
        val[heads] = np.minimum(self.since[bs], np.minimum.accumulate(lcp)[s[heads]])
        val = np.minimum(val, self.depth - 1) + np.uint8(1)
        val[heads[self.last[bs] < 0]] = 0  # nothing with this first character yet
        ends = np.append(heads[1:], len(s))
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        np.minimum(self.since, low, out=self.since)
        self.since[bs] = tail[s[ends - 1] + 1]
        self.last[bs] = prev[ends - 1]
        for c, a, b in zip(bs.tolist(), heads.tolist(), ends.tolist(), strict=True):
            self.queues[c].append(self.spool.put(prev[a:b], val[a:b]))


def falling_suffixes(t: np.ndarray, depth: int, memory: int = 64 << 20) -> Iterator[Batch]:
    """All suffixes of t in falling order of their first `depth` characters, as batches of (position, common prefix with
    the suffix before, up to depth). t: uint8, its last character 0."""
    if len(t) < 2:
        return
    is_s, run_end = _types(t)
    spool = Spool(memory)
    run = lambda p: int(run_end[p]) - int(p) + 1
    try:
        stars, star_lcp = _sorted_stars(t, is_s, depth)
        bounds = np.searchsorted(t[stars], np.arange(257))
        rising = _Sweep(t, is_s, False, depth, spool)
        for c in range(256):
            i, q = 0, rising.queues[c]
            while i < len(q):  # grows while it is read
                end = spool.upto(q, i)
                whole = spool.joined(q[i:end])
                q[i:end] = [spool.put(*whole)]
                rising.take(*whole)
                i += 1
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                lcp = star_lcp[a:b].copy()
                lcp[0] = min(depth, run(rising.last[c]), run(stars[a])) if q else 0
                rising.take(stars[a:b], lcp)
        falling = _Sweep(t, is_s, True, depth, spool)
        for c in range(255, -1, -1):
            i, q, prev = 0, falling.queues[c], -1
            while i < len(q):
                end = spool.upto(q, i)
                batch = spool.joined(q[i:end])
                q[i:end] = [None] * (end - i)
                yield batch
                falling.take(*batch)
                prev = int(batch[0][-1])
                i = end
            if c == 0:
                yield np.array([len(t) - 1], dtype=np.uint32), np.zeros(1, dtype=np.uint8)
            carried = 0 if prev < 0 else None
            for chunk in reversed(rising.queues[c]):
                pos, lcp = spool.get(chunk, last=True)
                down = np.empty(len(pos), dtype=np.uint8)
                down[1:] = lcp[:0:-1]
                down[0] = min(depth, run(prev), run(pos[-1])) if carried is None else carried
                carried = lcp[0]
                batch = pos[::-1], down
                yield batch
                falling.take(*batch)
            rising.queues[c] = []
    finally:
        spool.close()
