"""A minimal acyclic automaton of keys in one byte buffer, walked from many places of text at once.

Built from sorted keys a depth at a time; states with the same continuations are one. A move is a state and a
character as one number in an open-addressed table, so a step of all places is a probe or two each, and the buffer is
used as it is, without being unpacked. Each move also counts the keys that sort before, so a walk ends with the key's
number in sorted order, by which other columns of a key are found.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from .spans import _mixed, code_points

_LABEL = 21  # bits of a code point
_HEAD = struct.Struct("<4sqq")
_NAME = b"ACY1"


def _trie(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, label, depth of each edge; edge i leads to node i + 1; whether a node ends a key; depth of nodes) of sorted distinct keys."""
    points, starts = code_points(keys)
    size = np.diff(starts)
    parents, labels, depths, ends = [], [], [], [np.zeros(1, dtype=bool)]
    alive, node, made, depth = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64), 1, 0
    while True:
        alive = alive[size[alive] > depth]
        if not len(alive):
            break
        label, parent = points[starts[alive] + depth].astype(np.int64), node[alive]
        new = np.ones(len(alive), dtype=bool)
        new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
        child = np.cumsum(new) - 1
        end = np.zeros(int(child[-1]) + 1, dtype=bool)
        end[child[size[alive] == depth + 1]] = True
        parents.append(parent[new])
        labels.append(label[new])
        depths.append(np.full(len(end), depth))
        ends.append(end)
        node[alive] = made + child
        made += len(end)
        depth += 1
    none = np.zeros(0, dtype=np.int64)
    cat = lambda x: np.concatenate(x) if x else none
    return cat(parents), cat(labels), cat(depths), np.concatenate(ends)


def _first_slot(move: np.ndarray, slots: int) -> np.ndarray:
    high = (move.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((high * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)


def _next_slot(slot: np.ndarray, slots: int) -> np.ndarray:
    return np.where(slot + 1 < slots, slot + 1, 0)


def _slots(moves: np.ndarray) -> tuple[np.ndarray, int]:
    """(slot of each move, slots): the next free one from its first, in a table two thirds full."""
    slots = len(moves) + len(moves) // 2 + 2
    taken = np.zeros(slots, dtype=bool)
    out, left = _first_slot(moves, slots), np.arange(len(moves))
    while len(left):
        _, first = np.unique(out[left], return_index=True)
        won = np.zeros(len(left), dtype=bool)
        won[first] = ~taken[out[left[first]]]
        taken[out[left[won]]] = True
        left = left[~won]
        out[left] = _next_slot(out[left], slots)
    return out, slots


class Automaton:
    def __init__(self, buffer: bytes):
        """Views into the buffer; nothing is copied."""
        name, moves, states = _HEAD.unpack_from(buffer)
        if name != _NAME:
            raise ValueError("not an automaton")
        at = _HEAD.size
        views = []
        for kind, n in ((np.int64, moves), (np.int32, moves), (np.int32, moves), (np.bool_, states)):
            views.append(np.frombuffer(buffer, dtype=kind, count=n, offset=at))
            at += views[-1].nbytes
        self.moves, self.skips, self.targets, self.ends = views
        self.buffer = buffer

    @staticmethod
    def build(keys: Iterable[str]) -> Automaton:
        keys = sorted({k for k in keys if k})
        parent, label, depth, ends = _trie(keys)
        n = len(ends)
        child = np.arange(1, n)
        below = ends.astype(np.int64)  # keys from a node on
        marks = [_mixed(ends.astype(np.uint64) + np.uint64(salt)) for salt in (11, 1 << 40)]  # what a node's continuations are, as sums
        bounds = np.searchsorted(depth, np.arange((depth[-1] if len(depth) else -1) + 2))
        for a, b in zip(bounds[:-1][::-1], bounds[1:][::-1], strict=True):
            np.add.at(below, parent[a:b], below[child[a:b]])
            for mark in marks:
                np.add.at(mark, parent[a:b], _mixed(_mixed(mark[child[a:b]]) + label[a:b].astype(np.uint64)))
        order = np.lexsort(marks)
        new = np.ones(n, dtype=bool)
        new[1:] = (marks[0][order[1:]] != marks[0][order[:-1]]) | (marks[1][order[1:]] != marks[1][order[:-1]])
        state = np.empty(n, dtype=np.int64)
        state[order] = np.cumsum(new) - 1
        chosen = np.zeros(n, dtype=bool)
        chosen[order[new]] = True
        root = int(state[0])  # becomes state 0
        state = np.where(state == root, 0, np.where(state == 0, root, state))
        own = np.flatnonzero(chosen[parent])
        moves = (state[parent[own]] << _LABEL) | label[own]
        rank = np.argsort(moves)
        own, moves = own[rank], moves[rank]
        before = np.cumsum(below[child[own]]) - below[child[own]]
        group = moves >> _LABEL
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
        sizes = np.diff(np.append(heads, len(group)))
        skips = before - np.repeat(before[heads], sizes) + ends[parent[own]]
        final = np.zeros(int(new.sum()), dtype=bool)
        final[state] = ends
        slot, slots = _slots(moves)
        table = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        for column, values in zip(table, (moves, skips, state[child[own]]), strict=True):
            column[slot] = values
        return Automaton(_HEAD.pack(_NAME, slots, len(final)) + b"".join(p.tobytes() for p in (*table, final)))

    def _find_moves(self, move: np.ndarray) -> np.ndarray:
        """Slot of each move, -1 where there is none."""
        slot = _first_slot(move, len(self.moves))
        seen = self.moves[slot]
        open_ = np.flatnonzero((seen != move) & (seen >= 0))
        while len(open_):
            slot[open_] = _next_slot(slot[open_], len(self.moves))
            seen[open_] = self.moves[slot[open_]]
            open_ = open_[(seen[open_] != move[open_]) & (seen[open_] >= 0)]
        slot[seen < 0] = -1
        return slot

    def longest(self, points: np.ndarray, starts: np.ndarray, limits: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(end or -1, number in sorted order) of the longest key at each start that ends at limits or before, and where allowed[end]."""
        best = np.full(len(starts), -1, dtype=np.int64)
        number = np.zeros(len(starts), dtype=np.int64)
        alive = np.flatnonzero(starts < limits)
        at, state, rank = starts[alive], np.zeros(len(alive), dtype=np.int64), np.zeros(len(alive), dtype=np.int64)
        while len(alive):
            move = (state << _LABEL) | points[at]
            i = self._find_moves(move)
            on = i >= 0
            alive, at, i = alive[on], at[on] + 1, i[on]
            state, rank = self.targets[i].astype(np.int64), rank[on] + self.skips[i]
            hit = self.ends[state] if allowed is None else self.ends[state] & allowed[at]
            best[alive[hit]], number[alive[hit]] = at[hit], rank[hit]
            on = at < limits[alive]
            alive, at, state, rank = alive[on], at[on], state[on], rank[on]
        return best, number

    def find(self, keys: list[str]) -> np.ndarray:
        """Number of each key, -1 where it is none."""
        points, starts = code_points(keys)
        end, number = self.longest(points, starts[:-1], starts[1:])
        return np.where(end == starts[1:], number, -1) if len(keys) else number


def greedy(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the hits (by rising start) that leftmost-longest matching keeps: each next one starts where the last ended, or later."""
    behind, kept, i, n = np.searchsorted(starts, ends).tolist(), [], 0, len(starts)
    while i < n:
        kept.append(i)
        i = behind[i]
    return np.array(kept, dtype=np.int64)
