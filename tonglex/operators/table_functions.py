"""SQL table functions whose columns follow from the table they are given: a row for each token or hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from tonglex.functions.automaton import Automaton

from .packed import FINDERS, segments

AT_ONCE = 1 << 20  # characters, and 4096 rows, that are looked up together
ROWS = 4096
_int, _long, _string = T.IntegerType(), T.LongType(), T.StringType()
TOKEN = [T.StructField("tok_pos", _int), T.StructField("first", _int), T.StructField("end", _int), T.StructField("token", _string)]
HIT = [T.StructField("tok_pos", _int), T.StructField("idx_pos", _int), T.StructField("word_id", _long)]


def result_of(table: AnalyzeArgument, doc: AnalyzeArgument, text: AnalyzeArgument, more: list[T.StructField]) -> AnalyzeResult:
    """The column `doc` as it is, then `more`; of the table only `doc` and `text` are read. Raises on what does not fit."""
    if not table.isTable or doc.value is None or text.value is None:
        raise ValueError("give TABLE(...), then the names of its columns of ids and texts")
    known = {f.name: f for f in table.dataType.fields}
    for name in (doc.value, text.value):
        if name not in known:
            raise ValueError(f"no column {name!r}; there are {', '.join(known)}")
    if known[text.value].dataType != _string:
        raise ValueError(f"column {text.value!r} is no string")
    clash = {doc.value} & {f.name for f in more}
    if clash:
        raise ValueError(f"the column of ids must not be called {clash.pop()!r}")
    chosen = [SelectedColumn(f"`{n}`") for n in dict.fromkeys((doc.value, text.value))]
    return AnalyzeResult(T.StructType([T.StructField(doc.value, known[doc.value].dataType), *more]), select=chosen)


class _Batched:
    """Rows are put by until they are worth a pass. A NULL text has no rows."""

    def __init__(self):
        self.ids: list = []
        self.texts: list[str] = []
        self.size = 0

    def eval(self, row: T.Row, doc: str, text: str, *more: str) -> Iterator[tuple]:
        self.more = more
        if row[text] is None:
            return
        self.ids.append(row[doc])
        self.texts.append(row[text])
        self.size += len(row[text])
        if self.size >= AT_ONCE or len(self.ids) >= ROWS:
            yield from self._flush()

    def terminate(self) -> Iterator[tuple]:
        if self.ids:
            yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        ids, texts = self.ids, self.texts
        self.ids, self.texts, self.size = [], [], 0
        yield from self._rows(ids, texts)


def token_rows(buffer: Broadcast):
    """The table function of tokens by the buffer of an automaton: id, tok_pos, first, end (characters of the text), token."""
    class Tokens(_Batched):
        @staticmethod
        def analyze(table: AnalyzeArgument, doc: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            return result_of(table, doc, text, TOKEN)

        def _rows(self, ids: list, texts: list[str]) -> Iterator[tuple]:
            row, first, end, _ = segments(texts, Automaton(buffer.value))
            number = np.arange(len(row)) - np.searchsorted(row, row)
            for r, k, a, b in zip(row.tolist(), number.tolist(), first.tolist(), end.tolist(), strict=True):
                yield ids[r], k, a, b, texts[r][a:b]

    return F.udtf(Tokens, useArrow=True)


def hit_rows(sent: Broadcast):
    """The table function of hits by the lexicon that tasks have: id, tok_pos, idx_pos, word_id. A third name says how texts are
    looked up: chinese (the default; as they are), english or pinyin (normalised and lower-cased)."""
    class Found(_Batched):
        @staticmethod
        def analyze(table: AnalyzeArgument, doc: AnalyzeArgument, text: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
            if kind is not None and kind.value not in FINDERS:
                raise ValueError(f"{kind.value!r} is none of {', '.join(FINDERS)}")
            return result_of(table, doc, text, HIT)

        def _rows(self, ids: list, texts: list[str]) -> Iterator[tuple]:
            kind = self.more[0] if self.more else "chinese"
            hits = FINDERS[kind](texts, sent.value.kinds[kind])
            for r, *hit in zip(hits.row.tolist(), hits.token.tolist(), hits.place.tolist(), hits.word.tolist(), strict=True):
                yield ids[r], *hit

    return F.udtf(Found, useArrow=True)


def register(spark: SparkSession, buffer: Broadcast, sent: Broadcast, prefix: str = "") -> None:
    spark.udtf.register(f"{prefix}token_rows", token_rows(buffer))
    spark.udtf.register(f"{prefix}hit_rows", hit_rows(sent))
