"""Lookups over whole tables of texts.

Each takes df, the names of its id and text columns, and a lexicon, and returns rows
(id, tok_pos, idx_pos, word_id); texts without hits have no rows. Order is (tok_pos, idx_pos). Each row of df is
looked up for itself, so ids may be null or repeat. Lexicons of checked size go to the tasks in one broadcast
variable and need no shuffle; larger ones are joined, and only places with fingerprints or tokens are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonglex.functions.text import classify_normal, normalize, words
from tonglex.sources.lexicon import Lexicon
from tonglex.sources.staged import staged

from .packed import LONGEST, Keys, Packed, sliced
from .prefixes import CHUNK, Prepared, hot_join, longest_matches
from .segment import tokenize_join

HITS = "array<struct<tok_pos:int,idx_pos:int,word_id:bigint>>"
_FOUND = [T.StructField("tok_pos", T.IntegerType()), T.StructField("idx_pos", T.IntegerType()), T.StructField("word_id", T.LongType())]


# Lexicons in tasks --------------------------------------------------------------------------


def packed(lexicon: Lexicon) -> Broadcast:
    """The keys of a lexicon of checked size as one broadcast variable, made once."""
    if not lexicon.small():
        raise ValueError(f"the index has over {lexicon.broadcast_rows} rows or {lexicon.broadcast_bytes} bytes of keys")
    if lexicon.sent is None:
        frames = {"english": lexicon.part("english"), "pinyin": lexicon.part("pinyin"), "chinese": chinese_index(lexicon)}
        lexicon.sent = lexicon.index.sparkSession.sparkContext.broadcast(Packed({k: Keys.of(df.toArrow()) for k, df in frames.items()}))
    return lexicon.sent


def _rows_found(df: DataFrame, doc: str, given: Column, lexicon: Lexicon, kind: str) -> DataFrame:
    """Rows of hits by one pass of the tasks."""
    sent = packed(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hits = sent.value.find(kind, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits.row)), *hits.columns()], names=[doc, "tok_pos", "idx_pos", "word_id"])

    return df.select(doc, given.alias("_g")).mapInArrow(run, T.StructType([df.schema[doc], *_FOUND]))


def hits_column(given: Column, sent: Broadcast, kind: str) -> Column:
    """A column of hits of texts as `kind` takes them; NULL for NULL."""

    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        return sent.value.find(kind, texts).lists(texts.is_null().to_numpy(zero_copy_only=False))

    return found(given)


def english_hits(normal: Column, lexicon: Lexicon) -> Column:
    """Hits of normalised text in every task; adjacent equal ids are one."""
    return hits_column(F.lower(normal), packed(lexicon), "english")


# Joins --------------------------------------------------------------------------------------


def _by_token(tokens: DataFrame, doc: str, index: DataFrame) -> DataFrame:
    """tokens(doc, tok_pos, token, ...) joined to an index part (key, pos, word_id)."""
    more = [c for c in tokens.columns if c not in (doc, "tok_pos", "token")]
    return tokens.join(index, tokens["token"] == index["key"]).select(doc, *more, F.col("tok_pos").cast("int").alias("tok_pos"), F.col("pos").alias("idx_pos"), "word_id")


def _by_hot_token(tokens: DataFrame, doc: str, index: DataFrame, keyed: bool = False) -> DataFrame:
    """As _by_token, for an index of any size and tokens that may be in every text; keyed: the index is laid out by key."""
    own = staged(tokens, "tokens")
    more = [c for c in own.columns if c not in (doc, "tok_pos", "token")]
    found = hot_join(own, "token", index.select(F.col("key").alias("token"), "pos", "word_id"), [doc, "tok_pos"], keyed)
    return found.select(doc, *more, F.col("tok_pos").cast("int").alias("tok_pos"), F.col("pos").alias("idx_pos"), "word_id")


def query_by_simplified(df: DataFrame, doc: str, text: str, lexicon: Lexicon, kind: str = "simplified") -> DataFrame:
    """The raw text as one exact key: no trimming, folding or segmentation."""
    tokens, index = df.select(doc, F.lit(0).alias("tok_pos"), F.col(text).alias("token")), lexicon.part(kind)
    return _by_token(tokens, doc, F.broadcast(index)) if lexicon.small() else _by_hot_token(tokens, doc, index, lexicon.keyed)


def query_by_traditional(df: DataFrame, doc: str, text: str, lexicon: Lexicon) -> DataFrame:
    return query_by_simplified(df, doc, text, lexicon, "traditional")


def chinese_index(lexicon: Lexicon) -> DataFrame:
    """(key, pos, word_id): a key's simplified ids, then those traditional ones that are not among them; inner repeats stay."""
    if lexicon.keyed:
        return lexicon.part("chinese")
    s = lexicon.part("simplified")
    t = lexicon.part("traditional").join(s.select("key", "word_id"), ["key", "word_id"], "left_anti")
    both = s.select("key", F.lit(0).alias("part"), "pos", "word_id").unionByName(t.select("key", F.lit(1).alias("part"), "pos", "word_id"))
    order = Window.partitionBy("key").orderBy("part", "pos")
    return both.select("key", (F.row_number().over(order) - 1).alias("pos"), "word_id")


def query_by_chinese(df: DataFrame, doc: str, text: str, lexicon: Lexicon) -> DataFrame:
    """Segment the raw text, then the entries of every token; tokens are not compared with one another."""
    if lexicon.small():
        return _rows_found(df, doc, F.col(text), lexicon, "chinese")
    return _by_hot_token(tokenize_join(df, doc, text, lexicon.to_match("chinese")), doc, chinese_index(lexicon), lexicon.keyed)


def _pinyin_by_join(df: DataFrame, doc: str, normal: Column, lexicon: Lexicon) -> DataFrame:
    return _by_hot_token(df.select(doc, F.posexplode(words(normal)).alias("tok_pos", "token")), doc, lexicon.part("pinyin"), lexicon.keyed)


def query_by_pinyin(df: DataFrame, doc: str, text: str, lexicon: Lexicon) -> DataFrame:
    """Every word as a key of its own; unknown words are passed over, nothing is deduplicated."""
    normal = F.lower(normalize(F.col(text), pinyin=True))
    return _rows_found(df, doc, normal, lexicon, "pinyin") if lexicon.small() else _pinyin_by_join(df, doc, normal, lexicon)


def english_tokens_join(df: DataFrame, doc: str, normal: Column, keys: DataFrame | Prepared) -> DataFrame:
    """(doc, row, tok_pos, n, token) of leftmost-longest matches by joins, for keys of any number; row tells the rows of df apart."""
    kept = longest_matches(df, doc, F.lower(normal), keys, LONGEST)
    return kept.select(F.col("doc").alias(doc), "row", F.col("p").alias("tok_pos"), "n", F.col("key").alias("token"))


def adjacent_dedup(hits: DataFrame, doc: str) -> DataFrame:
    """Leave out hits whose word_id is that of the hit before, of the same `doc`. A text is looked at in chunks of places, each
    of which knows the last word before."""
    h = hits.withColumn("_c", F.expr(f"tok_pos div {CHUNK}"))
    last = h.groupBy(doc, "_c").agg(F.max_by("word_id", F.struct("tok_pos", "idx_pos")).alias("_w"))
    before = last.select(F.col(doc).alias("_d"), F.col("_c").alias("_k"), F.lag("_w").over(Window.partitionBy(doc).orderBy("_c")).alias("_b"))
    h = h.withColumn("_l", F.lag("word_id").over(Window.partitionBy(doc, "_c").orderBy("tok_pos", "idx_pos")))
    h = h.join(before, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("_c") == F.col("_k")))
    return h.withColumn("_l", F.coalesce("_l", "_b")).where("_l is null or _l <> word_id").select(*hits.columns)


def _english_by_join(df: DataFrame, doc: str, normal: Column, lexicon: Lexicon) -> DataFrame:
    tokens = english_tokens_join(df, doc, normal, lexicon.to_match("english"))
    hits = _by_hot_token(tokens, doc, lexicon.part("english"), lexicon.keyed)
    return adjacent_dedup(hits, "row").select(doc, "tok_pos", "idx_pos", "word_id")


def query_by_english(df: DataFrame, doc: str, text: str, lexicon: Lexicon) -> DataFrame:
    normal = F.lower(normalize(F.col(text)))
    return _rows_found(df, doc, normal, lexicon, "english") if lexicon.small() else _english_by_join(df, doc, normal, lexicon)


# Dispatch -----------------------------------------------------------------------------------


def _asked(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(_i, label, _t): each row's label, and its text as the lookup of that label takes it."""
    d = df.select(F.col(doc).alias("_i"), F.col(text).alias("_x"), normalize(F.col(text)).alias("_n"))
    d = d.select("_i", "_x", "_n", classify_normal(F.col("_n")).alias("label"))
    given = F.when(F.col("label") == "EN", F.lower("_n")).when(F.col("label") == "PY", F.lower(normalize(F.col("_x"), pinyin=True))).when(F.col("label") == "ZH", F.col("_n"))
    return d.select("_i", "label", given.alias("_t"))


def _entries_sent(lexicon: Lexicon) -> Broadcast | None:
    """Entries by id, where they are few enough."""
    if lexicon.entries_sent is None:
        n, size = lexicon.entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
        if n > lexicon.broadcast_rows or size > lexicon.broadcast_bytes:
            return None
        e = lexicon.entries.select("word_id", F.struct(*lexicon.entries.columns).alias("entry")).toArrow().combine_chunks().sort_by("word_id")
        lexicon.entries_sent = lexicon.entries.sparkSession.sparkContext.broadcast(e)
    return lexicon.entries_sent


def query(df: DataFrame, doc: str, text: str, lexicon: Lexicon, entries: bool = False) -> DataFrame:
    """(doc, label, hits) for every row of df: hits is NULL where the text cannot be classified, and an empty array where
    nothing is found. Hits are structs (tok_pos, idx_pos, word_id) in order. A NULL text has neither. With `entries`, every
    hit has its entry as a fourth field. A lexicon of checked size answers without any exchange."""
    asked = _asked(df, doc, text)
    if not lexicon.small():
        return _query_by_join(asked, doc, lexicon, entries)
    sent, known = packed(lexicon), _entries_sent(lexicon) if entries else None
    if entries and known is None:
        return _query_by_join(asked, doc, lexicon, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            labels, texts = batch.column("label"), batch.column("_t")
            hits = sent.value.answer(labels, texts).lists(texts.is_null().to_numpy(zero_copy_only=False), known.value if known else None)
            yield pa.RecordBatch.from_arrays([batch.column("_i"), labels, hits], names=[doc, "label", "hits"])

    fields = [*_FOUND, *([T.StructField("entry", lexicon.entries.schema)] if entries else [])]
    out = T.StructType([T.StructField(doc, asked.schema["_i"].dataType), T.StructField("label", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType(fields)))])
    return asked.mapInArrow(run, out)


def _query_by_join(asked: DataFrame, doc: str, lexicon: Lexicon, entries: bool) -> DataFrame:
    """Rows get numbers of their own, and hits find back to them; texts are written once and not shuffled."""
    d = staged(asked.withColumn("_row", F.monotonically_increasing_id()), "asked")
    parts = []
    for label, small, find in (("EN", "english", _english_by_join), ("PY", "pinyin", _pinyin_by_join)):
        own = d.where(F.col("label") == label).select("_row", "_t")
        parts.append(_rows_found(own, "_row", F.col("_t"), lexicon, small) if lexicon.small() else find(own, "_row", F.col("_t"), lexicon))
    parts.append(query_by_chinese(d.where("label = 'ZH'").select("_row", "_t"), "_row", "_t", lexicon))
    hits, fields = parts[0].unionByName(parts[1]).unionByName(parts[2]), ["tok_pos", "idx_pos", "word_id"]
    if entries:
        hits, fields = with_entries(hits, lexicon), [*fields, "entry"]
    hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    out = d.select("_row", "_i", "label").join(hits, "_row", "left")
    empty = F.array().cast(hits.schema["found"].dataType)
    return out.select(F.col("_i").alias(doc), "label", F.when(F.col("label") != "UN", F.coalesce("found", empty)).alias("hits"))


def with_entries(hits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Hit rows with their entries as a struct column."""
    e = lexicon.entries.select("word_id", F.struct(*lexicon.entries.columns).alias("entry"))
    return hits.join(e, "word_id")  # entries nest arrays of any length: their measured size decides how they are joined
