"""Which words are pinyin: a deterministic table over folded letters and tone numbers, for words of any length.

A word is a run of units: a syllable, perhaps with a tone number; a syllable with r and a tone number (huar3), or
an r with one of its own (r5). At its end a syllable of three letters or more may carry an r without a number (dianr):
such a word alone may as well be English (hair), so it counts only beside a plain word or with a tone mark.
"""

from __future__ import annotations

from functools import cache

#: The finals that each initial takes in Hanyu Pinyin (v for u with two dots).
SYLLABLES = {
    "": "a o e ai ei ao ou an en ang eng er",
    "y": "a o e ao ou an in ang ing ong i u ue uan un",
    "w": "a o ai ei an en ang eng u",
    "b": "a o ai ei ao an en ang eng i ie iao ian in ing u",
    "p": "a o ai ei ao ou an en ang eng i ie iao ian in ing u",
    "m": "a o e ai ei ao ou an en ang eng i ie iao iu ian in ing u",
    "f": "a o ei ou an en ang eng u",
    "d": "a e ai ei ao ou an en ang eng ong i ia ie iao iu ian ing u uo ui uan un",
    "t": "a e ai ei ao ou an ang eng ong i ie iao ian ing u uo ui uan un",
    "n": "a e ai ei ao ou an en ang eng ong i ie iao iu ian in iang ing u uo uan un v ve",
    "l": "a o e ai ei ao ou an ang eng ong i ia ie iao iu ian in iang ing u uo uan un v ve",
    "g": "a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
    "k": "a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
    "h": "a e ai ei ao ou an en ang eng ong u ua uo uai ui uan un uang",
    "j": "i ia ie iao iu ian in iang ing iong u ue uan un",
    "q": "i ia ie iao iu ian in iang ing iong u ue uan un",
    "x": "i ia ie iao iu ian in iang ing iong u ue uan un",
    "zh": "a e ai ei ao ou an en ang eng ong i u ua uo uai ui uan un uang",
    "ch": "a e ai ao ou an en ang eng ong i u ua uo uai ui uan un uang",
    "sh": "a e ai ei ao ou an en ang eng i u ua uo uai ui uan un uang",
    "r": "e ao ou an en ang eng ong i u ua uo ui uan un",
    "z": "a e ai ei ao ou an en ang eng ong i u uo ui uan un",
    "c": "a e ai ao ou an en ang eng ong i u uo ui uan un",
    "s": "a e ai ao ou an en ang eng ong i u uo ui uan un",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz12345"
NONE, PLAIN_WORD, WITH_R = 0, 1, 2  # kinds of words
_FIRST = 256  # the character that stands for the dead state; state n is chr(_FIRST + n)


def syllables() -> set[str]:
    return {i + f for i, finals in SYLLABLES.items() for f in finals.split()}


def _after(item: tuple, c: str, whole: set[str], begun: set[str]):
    """What may follow a place in a word: ("in", letters of a syllable), ("base", letters enough for a bare r), ("r", the same),
    ("alone",) after an r of its own, ("unit",) after a unit, ("start",)."""
    kind = item[0]
    if c.isdigit():
        if kind in ("base", "r", "alone"):
            yield ("unit",)
        return
    if kind == "in":
        p = item[1] + c
    elif kind in ("start", "unit", "base"):
        p = c
        if c == "r":
            yield ("alone",)
            if kind == "base":
                yield ("r", item[1])
    else:
        return
    if p in begun:
        yield ("in", p)
    if p in whole:
        yield ("base", len(p) >= 3)


def _kind(state: frozenset) -> int:
    if any(i[0] in ("base", "unit") for i in state):
        return PLAIN_WORD
    return WITH_R if ("r", True) in state else NONE


@cache
def table() -> tuple[list[str], list[int], int]:
    """(for each state a row of 1 + len(LETTERS) characters, the next state by letter; kind of word of each state; start). Column and
    state 0: no pinyin."""
    whole = syllables()
    begun = {s[:k] for s in whole for k in range(1, len(s) + 1)}
    begin, dead = frozenset([("start",)]), frozenset()
    moves, todo = {dead: [dead] * len(LETTERS)}, [begin]
    while todo:
        state = todo.pop()
        if state not in moves:
            moves[state] = [frozenset(x for i in state for x in _after(i, c, whole, begun)) for c in LETTERS]
            todo += moves[state]
    # states that no continuation tells apart are one
    group = {s: _kind(s) for s in moves}
    while True:
        seen: dict[tuple, int] = {}
        finer = {s: seen.setdefault((group[s], *(group[n] for n in moves[s])), len(seen)) for s in [dead, *(m for m in moves if m != dead)]}
        if len(set(finer.values())) == len(set(group.values())):
            break
        group = finer
    group = finer
    one = {group[s]: s for s in moves}
    rows = ["".join(chr(_FIRST + group[n]) for n in [dead, *moves[one[k]]]) for k in range(len(one))]
    return rows, [_kind(one[k]) for k in range(len(one))], group[begin]


def kind_of(word: str) -> int:
    """Kind of a folded, lower-cased word."""
    rows, kinds, state = table()
    for c in word:
        state = ord(rows[state][LETTERS.find(c) + 1]) - _FIRST
    return kinds[state]


def kind_sql(word: str) -> str:
    """The same as Spark SQL."""
    rows, kinds, start = table()
    step = f"ascii(substr(get(array({', '.join(map(repr, rows))}), s), position(c, '{LETTERS}') + 1, 1)) - {_FIRST}"
    return f"get(array({', '.join(map(str, kinds))}), aggregate(split({word}, ''), {start}, (s, c) -> {step}))"
