"""Greedy longest-prefix segmentation by headwords, in three tiers with equal results."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonglex.functions.automaton import Automaton

from .packed import SLICE_BYTES, segments
from .prefixes import Prepared, longest_matches

REGEX_KEYS = 300


def regex_tokens(text: Column, keys: list[str]) -> Column:
    """Built-in tier for a few hundred headwords: alternatives by falling length."""
    keys = sorted((k for k in set(keys) if k), key=lambda k: (-len(k), k))
    if not keys:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    pattern = "(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", k) for k in keys) + ")"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


class Segmenter:
    """Headwords as an automaton that is sent to the tasks once; the longest that starts at a place wins, else one character is passed over."""

    def __init__(self, keys):
        self.walk = Automaton.build(keys)
        self.sent: Broadcast | None = None

    def tokens(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        return [text[a:b] for a, b in zip(*(x.tolist() for x in segments([text], self.walk)[1:3]), strict=True)]

    def __call__(self, text: Column) -> Column:
        if self.sent is None:
            self.sent = SparkSession.active().sparkContext.broadcast(self.walk.buffer)
        return tokens_function(self.sent)(text)


def tokens_function(sent: Broadcast):
    """The function of a text's tokens in order, by the buffer of an automaton; NULL for NULL."""

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        walk, out = Automaton(sent.value), []
        at = 0
        while at < len(texts):  # few bytes at a time
            n = 1
            while at + n < len(texts) and texts.slice(at, 2 * n).nbytes <= SLICE_BYTES:
                n *= 2
            own = texts.slice(at, n).to_pylist()
            row, start, end, _ = segments([t or "" for t in own], walk)
            found: list[list[str] | None] = [None if t is None else [] for t in own]
            for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                found[r].append(own[r][a:b])
            out.append(pa.array(found, pa.list_(pa.string())))
            at += n
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return tokens


def tokenize(text: Column, keys: list[str]) -> Column:
    """Tokens of a text in order; characters of no headword are left out. NULL gives NULL."""
    return regex_tokens(text, keys) if len(set(keys)) <= REGEX_KEYS else Segmenter(keys)(text)


def tokenize_join(df: DataFrame, doc: str, text: str, headwords: DataFrame | Prepared) -> DataFrame:
    """(doc, tok_pos, token) by joins, for headwords of any number and texts of any length; each row of df for itself, whatever its id."""
    return longest_matches(df, doc, F.col(text), headwords).select(F.col("doc").alias(doc), "tok_pos", F.col("key").alias("token"))
