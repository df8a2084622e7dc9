"""Benchmark decontamination by latent semantic retrieval.

Documents become rows of numbers of words and terms, pairs of neighbouring words, that the benchmark
has too. Their passages, windows of 64 words that overlap by half, are TF-IDF rows of a matrix over
those terms, with document frequencies of the whole corpus. A distributed randomised SVD of all rows gives a latent
space in which passages are compared with the benchmark's items by cosine. Candidates are verified
word by word: longest common subsequence with the item, and a check for the item's answer.

The benchmark is read in blocks of at most BLOCK_BYTES, so what goes to the tasks is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, map_arrow, settled, stage_table, table, written
from .license_scan import DELETE, normal_words
from .words import column_words

BLOCK_BYTES = 256 << 10
HALF = 32  # words; a passage is two halves
RANK, OVERSAMPLE = 224, 32
OWN = 10.0  # least weight of the benchmark's own rows in the decomposition
OWN_SHARE = 0.5  # their squared weights against those of the corpus, whatever its size, so that no item falls out of the space
LEAST_WEIGHT = 0.6  # of a term no document has; what many copies of a paraphrase share of an item must outweigh what they changed
COSINE = 0.4
SIMILAR, PARAPHRASE, ANSWER = 0.8, 0.7, 0.8
SPREAD = 1.5  # a match lies within so many times the item's length


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray  # vocabulary numbers
    answer: np.ndarray
    terms: np.ndarray

    def __post_init__(self):
        self.distinct = np.unique(self.words)

    def has(self, words: np.ndarray) -> np.ndarray:
        return self.distinct[np.minimum(np.searchsorted(self.distinct, words), len(self.distinct) - 1)] == words


def _numbers(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 + place of each x in sorted_values, 0 if it isn't there."""
    if not len(sorted_values):
        return np.zeros(len(x), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at + 1, 0)


def _pairs(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of neighbouring words, both of the vocabulary, else 0; one for each word but the last."""
    a, b = words[:-1].astype(np.int64), words[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), a * (size + 1) + b, 0)


@dataclass
class Benchmark:
    vocabulary: np.ndarray  # sorted hashes; number i + 1 is vocabulary[i]
    pairs: np.ndarray  # sorted keys of terms
    items: list[Item]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Benchmark:
        hashed = []
        for item_id, text in rows:
            sentences = [s for s in re.split(r"[.!?\n]", text or "") if s.strip()]
            answer = normal_words(sentences[-1].encode()) if sentences else np.zeros(0, dtype=np.uint64)
            hashed.append((item_id, normal_words((text or "").encode()), answer))
        vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(w for _, w, _ in hashed)]))
        numbered = [(i, _numbers(vocabulary, w), _numbers(vocabulary, a)) for i, w, a in hashed if len(w)]
        keys = [_pairs(w, len(vocabulary)) for _, w, _ in numbered]
        pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *keys]))
        return Benchmark(vocabulary, pairs, [Item(i, w, a, _numbers(pairs, k)) for (i, w, a), k in zip(numbered, keys, strict=True)])


def _numbering(bench: Benchmark):
    bits = np.uint64((1 << 18) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> numbers of words and of terms, as little-endian 32-bit integers; texts without a term are left out."""
        # a direct table by the hash's low bits; the few words that share them go by search
        slot = np.full(1 << 18, -1, dtype=np.int32)
        slot[bench.vocabulary & bits] = np.arange(len(bench.vocabulary))
        crowded = len(np.unique(bench.vocabulary & bits)) < len(bench.vocabulary)
        square = len(bench.vocabulary) < 2000
        if square:
            table2 = np.zeros((len(bench.vocabulary) + 1) ** 2, dtype=np.int32)
            table2[bench.pairs] = np.arange(1, len(bench.pairs) + 1)
            table2[0] = 0
        for batch in batches:
            w, counts = column_words(batch.column("text").cast(pa.binary()), DELETE)
            at = slot[w & bits]
            if crowded:
                ids = np.zeros(len(w), dtype="<u4")
                some = np.flatnonzero(at >= 0)
                ids[some] = _numbers(bench.vocabulary, w[some])
            else:
                ids = np.where((at >= 0) & (bench.vocabulary[at] == w), at + 1, 0).astype("<u4")
            ends = np.cumsum(counts)
            key = np.append(_pairs(ids, len(bench.vocabulary)), 0) if len(ids) else np.zeros(0, dtype=np.int64)
            key[ends[counts > 0] - 1] = 0  # pairs stay within a text
            if square:
                term = table2[key].astype("<u4")
            else:
                both = np.flatnonzero(key)
                term = np.zeros(len(key), dtype="<u4")
                term[both] = _numbers(bench.pairs, key[both])
            found = np.diff(np.append(0, np.append(0, np.cumsum(term > 0))[ends])) > 0
            words, terms = [], []
            for a, b, yes in zip((ends - counts).tolist(), ends.tolist(), found.tolist(), strict=True):
                words.append(ids[a:b].tobytes() if yes else None)
                terms.append(term[a : b - 1].tobytes() if yes else None)
            words, terms = pa.array(words, pa.binary()), pa.array(terms, pa.binary())
            keep = words.is_valid()
            cols = [batch.column("doc_id"), batch.column("mark"), words, terms]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["doc_id", "mark", "words", "terms"])

    return run


def _document_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                total[np.unique(np.frombuffer(x.as_py(), dtype="<u4"))] += 1
        at = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


@dataclass
class Rows:
    """Sparse passages in order: entries (row, word, value) sorted by row; rows have unit length."""

    row: np.ndarray
    word: np.ndarray  # number of the term
    value: np.ndarray
    doc: np.ndarray  # of each row
    half: np.ndarray  # first half-passage of each row


def lone_terms(bench: Benchmark) -> np.ndarray:
    """Which terms are all that some item has."""
    lone = np.zeros(len(bench.pairs) + 1, dtype=bool)
    for i in bench.items:
        own = np.unique(i.terms[i.terms > 0])
        if len(own) == 1:
            lone[own] = True
    return lone


def passages(documents: list[np.ndarray], weight: np.ndarray, lone: np.ndarray) -> Rows:
    """TF-IDF rows of the documents' passages that have two weighted terms or more, or one that is lone."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    words = np.concatenate([np.zeros(0, dtype=np.int64), *documents]).astype(np.int64)
    doc = np.repeat(np.arange(len(documents)), lengths)
    at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = weight[words] > 0
    words, doc, half = words[some], doc[some], at[some] // HALF
    halves = -(-lengths // HALF)
    rows_of = np.maximum(halves - 1, 1)
    first = np.cumsum(rows_of) - rows_of
    own, before = half < rows_of[doc], half > 0
    row = np.concatenate([(first[doc] + half)[own], (first[doc] + half - 1)[before]])
    word = np.concatenate([words[own], words[before]])
    key, tf = np.unique(row * len(weight) + word, return_counts=True)
    row, word = key // len(weight), key % len(weight)
    names, row, n = np.unique(row, return_inverse=True, return_counts=True)
    enough = (n[row] >= 2) | lone[word]
    row, word, tf = row[enough], word[enough], tf[enough]
    kept, row = np.unique(row, return_inverse=True)
    names = names[kept]
    value = (1 + np.log(tf)) * weight[word]
    value = value / np.sqrt(np.bincount(row, value**2, len(names)))[row]
    d = np.searchsorted(first, names, side="right") - 1
    return Rows(row, word, value.astype(np.float32), d, names - first[d])


CHUNK = 1 << 12


def segment_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of x from each start to the next, in blocks of eight (reduceat over rows is many times slower)."""
    counts = np.diff(np.append(starts, len(x)))
    while len(counts) and counts.max() > 1:
        blocks = -(-counts // 8)
        base = np.cumsum(blocks) - blocks
        place = np.full(int(blocks.sum()) * 8, len(x))
        place[np.repeat(8 * base - starts, counts) + np.arange(len(x))] = np.arange(len(x))
        x = np.concatenate([x, np.zeros((1, x.shape[1]), dtype=x.dtype)])[place].reshape(-1, 8, x.shape[1]).sum(axis=1)
        starts, counts = base, blocks
    return x


def _chunks(r: Rows) -> Iterator[tuple[int, int, int, int]]:
    """(first entry, end entry, first row, end row) of chunks of whole rows."""
    starts = np.flatnonzero(np.concatenate([[True], r.row[1:] != r.row[:-1]])) if len(r.row) else np.zeros(0, dtype=np.int64)
    bounds = np.append(starts, len(r.row))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, side="right")) - 1)
        yield int(bounds[a]), int(bounds[b]), a, b
        a = b


def projected(r: Rows, base: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Chunks (entries, rows, the rows times base)."""
    for e0, e1, r0, r1 in _chunks(r):
        row = r.row[e0:e1]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        yield slice(e0, e1), slice(r0, r1), segment_sums(r.value[e0:e1, None] * base[r.word[e0:e1]], starts)


def gram_times(r: Rows, base: np.ndarray, out: np.ndarray) -> None:
    """out += A^T A base for the rows A."""
    for e, rows, y in projected(r, base):
        word = r.word[e]
        order = np.argsort(word, kind="stable")
        w = word[order]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        out[w[starts]] += segment_sums(r.value[e][order, None] * y[r.row[e][order] - rows.start], starts)


def _documents(batch: pa.RecordBatch, what: str = "terms") -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u4") for x in batch.column(what)]


def _summed(shape: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column("m"):
                total += np.frombuffer(x.as_py(), dtype="<f4").reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()])], names=["m"])

    return run


def tree_sum(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of matrices, one a task, over a tree in which a task adds 16 at most; at most 8 reach the driver."""
    n = df.rdd.getNumPartitions()
    while n > 8:
        n = -(-n // 16)
        df = df.select(F.floor(F.spark_partition_id() / 16).cast("int").alias("p"), "m").repartitionById(n, "p").mapInArrow(_summed(shape), "m binary")
    total = np.zeros(shape)
    for r in df.toLocalIterator():
        total += np.frombuffer(r["m"], dtype="<f4").reshape(shape)
    return total


def _over_passages(weight: np.ndarray, lone: np.ndarray, shape: tuple[int, ...], add: Callable[[Rows, np.ndarray], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.float64)
        for batch in batches:
            add(passages(_documents(batch), weight, lone), total)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()])], names=["m"])

    return run


def latent_space(numbers: DataFrame, bench: Benchmark, weight: np.ndarray, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 5) -> np.ndarray:
    """terms x rank: leading right singular vectors of all TF-IDF passages, those of the benchmark included."""
    size = len(weight)
    width = min(rank + oversample, size)
    lone = lone_terms(bench)
    own = passages([i.terms for i in bench.items], weight, lone)

    def products(r: Rows, out: np.ndarray) -> None:
        gram_times(r, start, out[:-1])
        out[-1, 0] += len(r.doc)  # rows have unit length: their number is the corpus's squared weight

    start = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    total = tree_sum(map_arrow(numbers, _over_passages(weight, lone, (size + 1, width), products), "m binary"), (size + 1, width))
    total, rows = total[:-1], total[-1, 0]
    own.value = own.value * np.float32(max(OWN, np.sqrt(OWN_SHARE * rows / max(len(own.doc), 1))))
    gram_times(own, start, total)
    q = np.linalg.qr(total)[0].astype(np.float32)

    def squares(r: Rows, out: np.ndarray) -> None:
        for _, _, y in projected(r, q):
            out += y.T @ y

    small = tree_sum(map_arrow(numbers, _over_passages(weight, lone, (width, width), squares), "m binary"), (width, width))
    squares(own, small)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(value)[::-1][:rank]
    return (q @ vector[:, lead[value[lead] > 1e-9 * max(value.max(), 1e-30)]]).astype(np.float32)


def common_subsequence(pattern: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel in the pattern."""
    mask: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in words.tolist():
        u = v & mask.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def verified(item: Item, words: np.ndarray) -> tuple[float, bool]:
    """(share of the item in a common subsequence with a stretch of SPREAD times its length, whether that counts as contamination)."""
    size = len(item.words)
    own = item.has(words)
    if own.sum() < PARAPHRASE * size or common_subsequence(item.words, words[own]) < PARAPHRASE * size:
        return 0.0, False
    best, yes, stretch = 0.0, False, int(SPREAD * size) + 1
    for at in range(0, max(1, len(words) - stretch + max(1, size // 4)), max(1, size // 4)):
        near = words[at : at + stretch][own[at : at + stretch]]
        share = common_subsequence(item.words, near) / size
        if share > best:
            best = share
            yes = share >= SIMILAR or (share >= PARAPHRASE and common_subsequence(item.answer, near) >= ANSWER * len(item.answer))
    return best, yes


MATCHES = "doc_id long, mark long, item_id long, similarity double, cosine double, first_word long"


def _search(bench: Benchmark, weight: np.ndarray, space: np.ndarray, cosine: float):
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(n, 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone = lone_terms(bench)
        own = passages([i.terms for i in bench.items], weight, lone)
        # targets of items of one term, by that term: beside many other terms their cosine is small, so holding the term is enough
        short = {int(t): own.row[own.word == t] for t in np.flatnonzero(lone)}
        targets = np.concatenate([np.zeros((0, space.shape[1]), dtype=np.float32), *(unit(y) for _, _, y in projected(own, space))])
        target_item = own.doc
        for batch in batches:
            documents = _documents(batch, "words")
            r = passages(_documents(batch), weight, lone)
            best: dict[tuple[int, int], tuple[float, float, int]] = {}
            for e, rows, y in projected(r, space):
                c = unit(y) @ targets.T
                near = c >= cosine
                for k in np.flatnonzero(lone[r.word[e]]) + e.start:
                    near[r.row[k] - rows.start, short[int(r.word[k])]] = True
                i, j = np.nonzero(near)
                for row, target, cos in zip((i + rows.start).tolist(), target_item[j].tolist(), c[i, j].tolist(), strict=True):
                    d, item = int(r.doc[row]), bench.items[target]
                    at = int(r.half[row]) * HALF
                    low = max(0, at - len(item.words))
                    share, yes = verified(item, documents[d][low : at + 2 * HALF + len(item.words)])
                    if yes and (share, cos) > best.get((d, target), (0.0, 0.0, 0))[:2]:
                        best[d, target] = share, cos, at
            docs, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            out = [(docs[d], marks[d], bench.items[t].item_id, *best[d, t]) for d, t in sorted(best)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")])

    return run


def weights(numbers: DataFrame, bench: Benchmark) -> np.ndarray:
    """Inverse document frequencies by term number, none under LEAST_WEIGHT of the greatest possible; 0 for 0."""
    size = len(bench.pairs)
    counts = map_arrow(numbers, _document_counts(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(size + 1)
    for r in counts.toLocalIterator():  # a row for each word of the block at most
        df[r["term"]] = r["n"]
    total = max(numbers.count(), 1)
    out = np.maximum(np.log((total + 1) / (df + 0.5)), LEAST_WEIGHT * np.log(2 * (total + 1)))
    out[0] = 0
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row per document row and item that it holds.

    Columns: doc_id, mark (a hash of the text, to tell rows of one doc_id apart), item_id, similarity (share of the item's
    words in the longest common subsequence), cosine, first_word of the passage.
    Defined results: null and empty texts match nothing, on either side; null ids are carried along; repeated rows and
    equal items are all returned; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("length(text) > 0")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    d = docs_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), F.lower("text").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        bench = Benchmark.of([(r["item_id"], r["text"]) for r in part.toLocalIterator()])
        if not bench.items:
            continue
        since = written()
        numbers = stage_table(map_arrow(d, _numbering(bench), "doc_id long, mark long, words binary, terms binary"), "numbers")
        weight = weights(numbers, bench)
        space = latent_space(numbers, bench, weight)
        out = out.union(settled(map_arrow(numbers, _search(bench, weight, space, cosine), MATCHES), "matches", since))
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")
