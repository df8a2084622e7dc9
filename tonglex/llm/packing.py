"""Best-fit packing of token pieces under several capacities at once.

Pieces have at most `max_tokens` tokens, so the plan is made on the histogram of piece lengths
(that many numbers, whatever the size of the corpus): pieces go by falling length into the open
bin whose residual vector (tokens, documents, attention cost) has the least weighted norm
afterwards, many equal bins at a time. Each piece then finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, map_arrow, stage_table, table

MAX_TOKENS = 2048
SALTS = 256


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence; attention cost is the sum of squared piece lengths. None: never binding."""

    tokens: int = MAX_TOKENS
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "residual_norm"  # or dot_product

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


@dataclass
class _Bins:
    """n equal bins; parts: (length, items a bin, rank of the first item)."""

    n: int
    left: np.ndarray
    parts: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, m: int) -> _Bins:
        """Take the first m bins off."""
        out = _Bins(m, self.left, list(self.parts))
        self.n -= m
        self.parts = [(length, k, start + m * k) for length, k, start in self.parts]
        return out


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, items a bin, first sequence, offset) that places every item of the histogram."""
    cap = capacity.vector()
    scale = np.array(capacity.weights) / cap
    groups: list[_Bins] = []
    left = np.zeros((64, 3), dtype=np.int64)  # of the open groups, by their number

    def opened(g: _Bins) -> None:
        nonlocal left
        if len(groups) == len(left):
            left = np.vstack([left, np.zeros_like(left)])
        left[len(groups)] = g.left
        groups.append(g)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while todo:
            n = len(groups)
            after = left[:n] - need
            fits = (after >= 0).all(axis=1)
            if fits.any():
                score = ((after * scale) ** 2).sum(axis=1) if capacity.score == "residual_norm" else -((left[:n] / cap) * (need / cap) * capacity.weights).sum(axis=1)
                score[~fits] = np.inf
                at = int(score.argmin())
                g = groups[at]
            else:
                k = int((cap // np.maximum(need, 1)).min())
                opened(_Bins(max(1, todo // k), cap.copy()))
                at, g = n, groups[n]
            k = int((g.left // np.maximum(need, 1)).min())
            bins = min(g.n, todo // k)
            if not bins:
                bins, k = 1, todo
            if bins < g.n:
                opened(g.split(bins))
                at, g = len(groups) - 1, groups[-1]
            g.parts.append((length, k, rank))
            g.left = g.left - k * need
            left[at] = g.left
            rank += bins * k
            todo -= bins * k
    out, sequence = [], 0
    for g in groups:
        offset = 0
        for length, k, start in g.parts:
            out.append((length, start, start + g.n * k, k, sequence, offset))
            offset += length * k
        sequence += g.n
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str | None, end_id: int, max_tokens: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                at, piece = 0, 0
                size = len(ids) % max_tokens or max_tokens  # the first piece takes what full ones leave
                while at < len(ids):
                    rows.append((doc, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, piece, size = at + size, piece + 1, max_tokens
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Token pieces of every document; only documents longer than max_tokens are cut, and only their first piece may be shorter."""
    return map_arrow(docs_of(docs), _cutter(tokenizer, end_id, max_tokens), PIECES)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined results: a null or empty text is one piece, the end id alone; null doc_ids and repeated
    rows are packed like any other; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    p = cut_pieces(docs, tokenizer, end_id, capacity.tokens)
    p = stage_table(p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    counts = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    segments = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, k long, sequence long, at long")
    first = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    p = p.withColumn("rank", F.row_number().over(order) - 1)
    p = p.join(F.broadcast(first), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))  # max_tokens x SALTS rows at most
    s = segments.withColumnRenamed("length", "s_length")
    p = p.join(F.broadcast(s), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return p.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("k")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
