"""Lexicons of checked size in tasks: keys in automata, their ids in flat arrays, whole batches of texts looked up at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tonglex.functions.automaton import Automaton, greedy
from tonglex.functions.spans import code_points

from .prefixes import word_places

LONGEST = 4  # words of an English key
PLACES = 1 << 19  # walked at a time
SLICE_BYTES = 2 << 20


@dataclass
class Keys:
    """Keys of a kind in sorted order, and the ids of each in their own order."""

    buffer: bytes
    first: np.ndarray  # of the ids of each key, and their end
    ids: np.ndarray
    _walk: Automaton | None = field(default=None, repr=False, compare=False)

    @staticmethod
    def of(index: pa.Table) -> Keys:
        """From rows (key, pos, word_id)."""
        index = index.filter(pc.not_equal(index.column("key"), "")).combine_chunks()
        keys = index.column("key").to_pylist()
        walk = Automaton.build(keys)
        number = walk.find(keys)
        order = np.lexsort((index.column("pos").to_numpy(), number))
        count = np.bincount(number, minlength=len(set(keys)))
        return Keys(walk.buffer, np.concatenate([[0], np.cumsum(count)]).astype(np.int64), index.column("word_id").to_numpy()[order])

    def __getstate__(self) -> tuple:
        return self.buffer, self.first, self.ids

    def __setstate__(self, state: tuple) -> None:
        self.buffer, self.first, self.ids = state
        self._walk = None

    @property
    def walk(self) -> Automaton:
        if self._walk is None:
            self._walk = Automaton(self.buffer)
        return self._walk

    def expand(self, row: np.ndarray, place: np.ndarray, number: np.ndarray) -> Hits:
        """A hit for each id of each key."""
        count = self.first[number + 1] - self.first[number]
        owner = np.repeat(np.arange(len(number)), count)
        at = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        return Hits(row[owner], place[owner], at, self.ids[self.first[number][owner] + at])


@dataclass
class Hits:
    """Rows of hits, by row of the batch, token and place among the token's ids."""

    row: np.ndarray
    token: np.ndarray
    place: np.ndarray
    word: np.ndarray

    def where(self, kept: np.ndarray) -> Hits:
        return Hits(self.row[kept], self.token[kept], self.place[kept], self.word[kept])

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.token, pa.int32()), pa.array(self.place, pa.int32()), pa.array(self.word, pa.int64())]

    def lists(self, none: np.ndarray, entries: pa.Table | None = None) -> pa.ListArray:
        """A list for each row of the batch, null where none says so; with entries(word_id, entry), each hit has its entry too."""
        fields, columns = [("tok_pos", pa.int32()), ("idx_pos", pa.int32()), ("word_id", pa.int64())], self.columns()
        if entries is not None:
            known = entries.column("word_id").to_numpy()
            columns.append(entries.column("entry").take(pa.array(np.searchsorted(known, self.word))).combine_chunks())
            fields.append(("entry", columns[-1].type))
        ends = np.cumsum(np.bincount(self.row, minlength=len(none)))
        rows = pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields])
        starts = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(none, False))
        return pa.ListArray.from_arrays(starts, rows)


def _walked(walk: Automaton, points: np.ndarray, starts: Callable, size: int, limits: Callable, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, end, number) of the places, of `size` of them, where a key starts; some at a time."""
    out = []
    for a in range(0, size, PLACES):
        places = np.arange(a, min(a + PLACES, size))
        end, number = walk.longest(points, starts(places), limits(places), allowed)
        hit = end >= 0
        out.append((places[hit], end[hit], number[hit]))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def english(texts: list[str], keys: Keys) -> Hits:
    """Leftmost-longest runs of up to LONGEST words of normalised, lower-cased texts; adjacent equal ids of a text are one."""
    points, row, _, start, end = word_places(texts)
    last = np.searchsorted(row, row, side="right") - 1
    reach = np.minimum(np.arange(len(row)) + LONGEST - 1, last)
    allowed = np.zeros(len(points) + 1, dtype=bool)
    allowed[end] = True
    place, stop, number = _walked(keys.walk, points, lambda w: start[w], len(start), lambda w: end[reach[w]], allowed)
    kept = greedy(place, np.searchsorted(end, stop) + 1)
    place, number = place[kept], number[kept]
    first_word = np.searchsorted(row, row[place])
    hits = keys.expand(row[place], place - first_word, number)
    new = np.ones(len(hits.row), dtype=bool)
    new[1:] = (hits.row[1:] != hits.row[:-1]) | (hits.word[1:] != hits.word[:-1])
    return hits.where(new)


def pinyin(texts: list[str], keys: Keys) -> Hits:
    """Every word of normalised, lower-cased texts as a key of its own."""
    points, row, word, start, end = word_places(texts)
    place, stop, number = _walked(keys.walk, points, lambda w: start[w], len(start), lambda w: end[w])
    whole = stop == end[place]
    return keys.expand(row[place[whole]], word[place[whole]], number[whole])


def segments(texts: list[str], walk: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start and end in its text, number) of the tokens of all texts."""
    points, first = code_points(texts)
    row_of = lambda p: np.searchsorted(first, p, side="right") - 1
    place, end, number = _walked(walk, points, lambda p: p, len(points), lambda p: first[row_of(p) + 1])
    kept = greedy(place, end)
    place, end, number = place[kept], end[kept], number[kept]
    row = row_of(place)
    return row, place - first[row], end - first[row], number


def chinese(texts: list[str], keys: Keys) -> Hits:
    """The ids of every token of texts."""
    row, _, _, number = segments(texts, keys.walk)
    return keys.expand(row, np.arange(len(row)) - np.searchsorted(row, row), number)


FINDERS = {"english": english, "pinyin": pinyin, "chinese": chinese}
LABELS = {"EN": "english", "PY": "pinyin", "ZH": "chinese"}


@dataclass
class Packed:
    """The keys of every kind."""

    kinds: dict[str, Keys]

    def find(self, kind: str, texts: pa.Array) -> Hits:
        return FINDERS[kind](texts.fill_null("").to_pylist(), self.kinds[kind])

    def answer(self, labels: pa.Array, texts: pa.Array) -> Hits:
        """Hits of texts that are looked up by label."""
        parts = []
        for label, kind in LABELS.items():
            rows = np.flatnonzero(pc.fill_null(pc.equal(labels, label), False).to_numpy(zero_copy_only=False))
            if len(rows):
                h = self.find(kind, texts.take(pa.array(rows)))
                parts.append(Hits(rows[h.row], h.token, h.place, h.word))
        if not parts:
            return Hits(*(np.zeros(0, dtype=np.int64) for _ in range(4)))
        both = Hits(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "token", "place", "word")))
        return both.where(np.argsort(both.row, kind="stable"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes, or of one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > SLICE_BYTES:
                todo += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            else:
                yield b
