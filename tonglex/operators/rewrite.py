"""Script conversion with phrase tables of any size: spans are found by the longest-match join and put back in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonglex.functions.convert import Scripts
from tonglex.sources.lexicon import Lexicon
from tonglex.sources.staged import dropped, staged

from .prefixes import hot_join, longest_matches

SCRIPTS = ("simplified", "traditional")


def conversion_table(lexicon: Lexicon, to: str) -> DataFrame:
    """(key, to): every headword of the other script and its best-ranked counterpart, and characters of pairs of equal length,
    unless a headword says otherwise."""
    other = SCRIPTS[1 - SCRIPTS.index(to)]
    e = lexicon.entries.select(F.col(other).alias("key"), F.col(to).alias("to"), F.struct("hsk", "word_id").alias("rank"))
    phrases = e.where("key <> ''").groupBy("key").agg(F.min_by("to", "rank").alias("to"))
    pairs = F.posexplode(F.arrays_zip(F.split("key", "").alias("a"), F.split("to", "").alias("b")))
    singles = e.where((F.length("key") == F.length("to")) & (F.col("key") != "")).select("rank", pairs.alias("at", "c"))
    singles = singles.groupBy(F.col("c.a").alias("key")).agg(F.min_by(F.col("c.b"), F.struct("rank", "at")).alias("to"))
    return phrases.unionByName(singles.join(phrases, "key", "left_anti"))


def rewritten(df: DataFrame, doc: str, text: str, table: DataFrame) -> DataFrame:
    """(doc, text, converted) of every row of df: leftmost-longest keys of table(key, to) replaced. NULL gives NULL.

    Texts are written once under a number of their own; only places and what changes there are joined, and come to their text
    in the end, in order.
    """
    d = staged(df.select(F.monotonically_increasing_id().alias("_row"), F.col(doc).alias("_i"), F.col(text).alias("_t")), "texts")
    known = staged(table.select("key", "to"), "phrases")
    kept = staged(longest_matches(d, "_row", F.col("_t"), known).select(F.col("doc").alias("_row"), "p", "n", "key"), "kept")
    changes = hot_join(kept, "key", known.where("key <> to"), ["_row", "p"])
    spans = changes.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("p", "n", "to"))).alias("spans"))

    @F.arrow_udf("string")
    def spliced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts, spans, strict=True):
            t = t.as_py()
            if t is not None and own.is_valid:
                parts, at = [], 0
                for s in own.as_py():
                    parts += [t[at : s["p"]], s["to"]]
                    at = s["p"] + s["n"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    out = staged(d.join(spans, "_row", "left").select(F.col("_i").alias(doc), F.col("_t").alias(text), spliced("_t", "spans").alias("converted")), "converted")
    dropped(d, known, kept)
    return out


def converted(df: DataFrame, doc: str, text: str, lexicon: Lexicon, to: str) -> DataFrame:
    """(doc, text, converted, same) of every row of df, to `simplified` or `traditional`; same: the text is of that script already.

    A lexicon of checked size converts in place, a larger one by joins; both take the longest phrase first, then characters.
    """
    if to not in SCRIPTS:
        raise ValueError(f"a script is one of {SCRIPTS}")
    if lexicon.small():
        s = Scripts(lexicon.pairs())
        f = s.traditional_to_simplified if to == "simplified" else s.simplified_to_traditional
        out = df.select(doc, text, f(F.col(text)).alias("converted"))
    else:
        out = rewritten(df, doc, text, conversion_table(lexicon, to))
    return out.withColumn("same", F.col("converted") == F.col(text))
