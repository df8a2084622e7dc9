"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of eight segments. If two fingerprints differ in at most
three bits, some chain of consecutive segments keeps every prefix of l segments within
floor(3 l / 8) differences: none in two segments, at most one in five. So two segments agree
exactly, and two of the next three; that gives 24 exact 32-bit keys per fingerprint. Pairs
within a key are pruned by the whole chain before the full Hamming check, and only a spanning
forest of each key's links goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, map_arrow, row_key, settled, stage_table, table, with_rows, written
from .components import connected_components, forest
from .similar_texts import FEATURES, features, similar_links

MAX_DISTANCE = 3
SEGMENTS = 8
#: Keys with more distinct fingerprints are keyed again on more bits, after which no key can have over 2**17.
WIDE = 4096


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of word shingles, unsigned; A-Z is lower-cased, words are split at ASCII white space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but text, and the text's fingerprint."""
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())), dtype=np.uint64, count=batch.num_rows)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fp.view(np.int64))], names=[*rest.schema.names, "fp"])


def _all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but text, the text's fingerprint, and the features of its shingle set."""
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        fp = np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts))
        keys, set_fp, parity, n = zip(*map(features, texts), strict=True)
        rest = batch.drop_columns(["text"])
        cols = [*rest.columns, pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(set_fp, pa.int64()), pa.array(parity, pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*rest.schema.names, "fp", "keys", "set_fp", "parity", "n"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): the fingerprint as a signed long."""
    return map_arrow(docs_of(docs), _fingerprints, "doc_id long, fp long")


def ring_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: number of the key in bits 32 up, four exact segments below."""
    seg = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)) for k in range(SEGMENTS)]
    out = []
    for i in range(SEGMENTS):
        for c, pair in enumerate(combinations((2, 3, 4), 2)):
            parts = [seg[(i + j) % SEGMENTS] for j in (0, 1, *pair)]
            key = F.lit((i * 3 + c) << 32)
            for n, p in enumerate(parts):
                key = key.bitwiseOR(F.shiftleft(p, 8 * n))
            out.append(key)
    return F.array(*out)


def _rest(number: int) -> list[int]:
    """The bits that key `number` leaves open, in order."""
    i, pair = number // 3, list(combinations((2, 3, 4), 2))[number % 3]
    exact = {(i + j) % SEGMENTS for j in (0, 1, *pair)}
    return [8 * s + b for s in range(SEGMENTS) if s not in exact for b in range(8)]


#: The 32 open bits in six parts: three differences leave three parts alone, so 20 choices of three find every pair.
PARTS = (0, 5, 10, 15, 20, 26, 32)


def deep_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sub, fp) rows: 20 longer keys for every row of a wide key; sub holds the choice and 15 to 17 more exact bits."""
    keys, subs, fps = [], [], []
    for number in np.unique(key >> 32):
        rows = (key >> 32) == number
        f = fp[rows].view(np.uint64)
        bits = _rest(int(number))
        parts = []
        for a, b in zip(PARTS, PARTS[1:], strict=False):
            v = np.zeros(len(f), dtype=np.int64)
            for bit in bits[a:b]:
                v = (v << 1) | ((f >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            parts.append(v)
        for c, three in enumerate(combinations(range(6), 3)):
            sub = np.full(len(f), c + 1, dtype=np.int64)
            for p in three:
                sub = (sub << (PARTS[p + 1] - PARTS[p])) | parts[p]
            keys.append(key[rows])
            subs.append(sub)
            fps.append(fp[rows])
    return np.concatenate(keys), np.concatenate(subs), np.concatenate(fps)


def chain_ok(x: np.ndarray, start: int) -> np.ndarray:
    """Whether the differences x keep to their share from segment `start` on, for every length of the chain."""
    s = np.uint64(8 * start)
    turned = (x >> s) | (x << np.uint64((64 - 8 * start) % 64)) if start else x
    ok = np.ones(x.shape, dtype=bool)
    for length in (2, 5, 7):  # the shares 0, 1 and 2 end here; shorter chains follow from these
        ok &= np.bitwise_count(turned & np.uint64((1 << (8 * length)) - 1)) <= MAX_DISTANCE * length // SEGMENTS
    return ok


def links(fp: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as edges (node, root), of the distinct fingerprints fp at MAX_DISTANCE or less within a key of segment `start`."""
    f = fp.view(np.uint64)
    n = len(f)
    vary = int(np.bitwise_or.reduce(f ^ f[0]))
    open_bits = [b for b in range(64) if vary >> b & 1]
    if n > 512 and len(open_bits) <= 17:
        return _dense(fp, open_bits)
    a, b = [], []
    for at in range(0, n, 256):
        x = f[at : at + 256, None] ^ f[None, at:]
        i, j = np.nonzero(chain_ok(x, start))
        near = (np.bitwise_count(x[i, j]) <= MAX_DISTANCE) & (i < j)
        i, j = i[near], j[near]
        if len(i):
            x, r = forest(fp[at + i], fp[at + j])  # never more edges than nodes
            a.append(x)
            b.append(r)
    if not a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def _dense(fp: np.ndarray, open_bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """links() by turning up to three of at most 17 open bits and looking the result up in a table."""
    f = fp.view(np.uint64)
    v = np.zeros(len(f), dtype=np.int64)
    for n, bit in enumerate(open_bits):
        v |= ((f >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << n
    where = np.full(1 << len(open_bits), -1, dtype=np.int64)
    where[v] = np.arange(len(v))
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for k in range(1, MAX_DISTANCE + 1):
        for turn in combinations(range(len(open_bits)), k):
            other = where[v ^ sum(1 << t for t in turn)]
            hit = other > np.arange(len(v))
            if hit.any():
                a, b = forest(np.concatenate([a, np.flatnonzero(hit)]), np.concatenate([b, other[hit]]))
    return fp[a], fp[b]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) sorted by key, sub -> links as (key -1, a, b), and the rows of wide keys as (key, 0, fp).

    At most WIDE rows of a first-level key are held; a longer one (sub 0) is passed on row by row.
    """
    names = ["key", "a", "b"]
    held: list[np.ndarray] = []  # rows of the key that may go on in the next batch
    passing = None  # the wide key that is being passed on

    def wide(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(np.zeros(rows.shape[1], dtype=np.int64)), pa.array(rows[2])], names=names)

    def found(rows):
        """Links of whole keys."""
        key, sub, fp = rows
        cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = ends - starts
        a, b = [], []
        two = starts[size == 2]
        x = fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)
        near = np.bitwise_count(x) <= MAX_DISTANCE
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            if e - s > WIDE and not sub[s]:
                yield wide(rows[:, s:e])
                continue
            x, r = links(fp[s:e], int(key[s] >> 32) // 3)
            a.append(x)
            b.append(r)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, dtype=np.int64)), pa.array(a), pa.array(b)], names=names)

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        if passing is not None:
            on = rows[0] == passing
            if on.any():
                yield wide(rows[:, on])
                rows = rows[:, ~on]
            if not rows.shape[1]:
                continue
            passing = None
        rows = np.concatenate([*held, rows], axis=1)
        if not rows.shape[1]:
            continue
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        if not last.all():
            yield from found(rows[:, ~last])
        tail = rows[:, last]
        held = [tail]
        if tail.shape[1] > WIDE and not tail[1, 0]:
            yield wide(tail)
            passing, held = tail[0, 0], []
    if held and held[0].shape[1]:
        yield from found(held[0])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key, sub, fp = deep_keys(batch.column("key").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), pa.array(fp)], names=["key", "sub", "fp"])


def near_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect all pairs at MAX_DISTANCE or less."""
    keyed = fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), F.lit(0).cast("long").alias("sub"), "fp")
    schema = "key long, a long, b long"
    first = stage_table(map_arrow(keyed.repartition("key").sortWithinPartitions("key"), _by_key, schema, rows=None), "links")
    hot = first.where("key >= 0")
    edges = first.where("key < 0").select("a", "b")
    if not hot.isEmpty():
        deep = hot.mapInArrow(_deeper, "key long, sub long, fp long").repartition("key", "sub").sortWithinPartitions("key", "sub")
        edges = edges.union(deep.mapInArrow(_by_key, schema).select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, fp, fingerprint, component_id.

    Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id
    never becomes a component's id unless its component has no other; repeated rows share a component;
    an empty table gives an empty result; other columns are ignored.
    """
    f = stage_table(fingerprints(docs), "simhash")
    per = stage_table(f.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")  # exact copies meet here, pre-aggregated
    roots = connected_components(near_links(per.select("fp")))
    member = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(ids, "root").select("fp", "component_id")
    return f.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one is left for each group of near copies.

    A group hangs together by fingerprints at MAX_DISTANCE or less and by texts of resemblance 0.8 or more on five-word
    shingles. The smallest doc_id stays, a null one before all others; of rows with equal doc_ids that with the
    smallest hash of its text, and equal rows stay once.
    """
    since = written()
    key_id, key_mark = row_key(docs)
    rows = docs.select(key_id, key_mark, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    f = stage_table(map_arrow(rows, _all_features, "key_id long, key_mark long, fp long, " + FEATURES), "simhash")
    least = F.min(F.struct("key_id", "key_mark")).alias("least")
    per = stage_table(f.groupBy("fp").agg(least), "classes")
    # of each different text, the first row; all its other columns follow from the text
    first = f.groupBy("key_mark").agg(F.min("key_id").alias("key_id"), F.first(F.struct(F.col("fp").alias("node"), "keys", "set_fp", "parity", "n")).alias("x"))
    first = stage_table(first.select("key_id", "key_mark", "x.*"), "texts")
    roots = connected_components(similar_links(first, rows, stage_table(near_links(per.select("fp")), "near")))
    member = per.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = member.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    return with_rows(docs, settled(kept, "kept", since), "left_semi", single=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
