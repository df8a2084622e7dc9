"""Script conversion from a lexicon's word pairs, and predicates built on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Converter:
    """Longest phrase first, then single characters; the first pair of a phrase counts.

    pairs: (from, to) in order of preference. Characters of pairs of equal length also convert one by one,
    unless a pair of single characters says otherwise.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.phrases: dict[str, str] = {}
        for a, b in pairs:
            self.phrases.setdefault(a, b)
        for a, b in pairs:
            if len(a) == len(b):
                for x, y in zip(a, b, strict=True):
                    self.phrases.setdefault(x, y)
        self.longest = max(map(len, self.phrases), default=0)
        self.regular = all(
            len(a) == len(b) and all(self.phrases[x] == y for x, y in zip(a, b, strict=True)) for a, b in self.phrases.items()
        )

    def convert(self, text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                found = self.phrases.get(text[at : at + n])
                if found is not None:
                    out.append(found)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: Column) -> Column:
        """A built-in translation where phrases add nothing to characters, else an Arrow function."""
        if self.regular:
            single = {a: b for a, b in self.phrases.items() if len(a) == 1}
            return F.translate(text, "".join(single), "".join(single.values()))

        @F.pandas_udf("string")
        def converted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield s.map(self.convert)

        return converted(text)


class Scripts:
    def __init__(self, pairs: list[tuple[str, str]]):
        """pairs: (traditional, simplified)."""
        self.simplified_to_traditional = Converter([(s, t) for t, s in pairs])
        self.traditional_to_simplified = Converter(pairs)

    def is_traditional(self, text: Column) -> Column:
        return self.simplified_to_traditional(text) == text

    def is_simplified(self, text: Column) -> Column:
        return self.traditional_to_simplified(text) == text
