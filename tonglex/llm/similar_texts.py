"""Texts of resemblance 0.8 or more on five-word shingles, for the near-duplicate stage.

At that resemblance 64-bit fingerprints differ in up to some 20 bits, where exact keys over the bits
no longer select. Sets of at most SMALL shingles are found exactly: in order of their hashes, two sets
at 0.8 share one of their first n - ceil(0.8 n) + 1 shingles. Parities of 64 classes of shingles, whose
differences never exceed those of the sets, prune the pairs. For larger sets the ring is laid over
the shingles: they are dealt by hash into parts of two to eight, and two such sets that differ little
agree exactly in some parts. Equal parts make candidates, fingerprints and sizes prune them, and exact
resemblance decides. With 32 parts on a level that both sets have, a pair at 0.8 shares none with a
probability under 0.001.

Within a key each text is compared with all others by fingerprint, and its four nearest go on to the
exact check, which joins most groups. Keys that hold more pairs stay open. If such a key still has more
than one group, its texts get sketches, parities of at least twice as many classes as they have shingles.
Differences of sketches never exceed those of the sets and come close to them, so hardly a pair under 0.8
stays within the bounds: first each text's four nearest in other groups, then every pair across groups
that does is checked. No unchecked pair within the bounds can join two groups; pairs inside a group change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, map_arrow, stage_table
from .components import connected_components
from .words import mix, shingle_hashes, word_hashes

WIDTH = 5
SIMILARITY = 0.8
PARTS = 32
MOST_BITS = 22  # at resemblance 0.8 fingerprints differ in 9.7 bits on average, with a deviation of 2.9
NEAREST = 4
SMALL = 64  # shingles; a set of up to 5/4 as many can be similar to such a one
BLOCK = 2048  # texts of one key compared with one another at a time
LEAST_CLASSES = 512  # of a sketch
SKETCHED = 1 << 16  # pairs whose sketches are compared at a time


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text.lower()), WIDTH))


def set_fingerprint(s: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 1 << 14):
        ones += np.unpackbits(s[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0]) if len(s) else 0


def parity_bits(s: np.ndarray) -> int:
    """Parity of the number of shingles in each of 64 classes: two sets differ in as many shingles as these in bits, or more."""
    return int(np.bitwise_xor.reduce(np.uint64(1) << (mix(s) & np.uint64(63)), initial=np.uint64(0)).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities as parity_bits, of a power of two classes, at least twice as many as shingles."""
    classes = max(LEAST_CLASSES, 1 << (2 * len(s) - 1).bit_length())
    at = (mix(s) & np.uint64(classes - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=classes) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each sketch, all with as many classes as the shortest: classes equal modulo that number become one."""
    words = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, words), axis=0) for x in sketches])


def prefix_keys(s: np.ndarray) -> np.ndarray:
    """Even keys of the first shingles of a sorted set, of which two sets at 0.8 share one."""
    return mix(s[: len(s) + 4 * len(s) // -5 + 1]) & ~np.uint64(1) if len(s) else s


def part_keys(s: np.ndarray) -> np.ndarray:
    """Odd keys of the parts of a shingle set on two levels; parts of one shingle don't count."""
    level = max(0, int(np.ceil(np.log2(max(len(s), 1) / 8))))
    out = []
    for k in (level, level + 1):
        part = (s >> np.uint64(24)) % np.uint64(1 << k)
        some = part < PARTS
        order = np.argsort(part[some], kind="stable")
        p, h = part[some][order], s[some][order]
        if not len(p):
            continue
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(starts, len(p)))
        key = mix(np.add.reduceat(mix(h), starts) + p[starts] * np.uint64(97) + np.uint64(k)) | np.uint64(1)
        out.append(key[size > 1])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def all_keys(s: np.ndarray) -> np.ndarray:
    """Prefix keys for pairs with a set of at most SMALL shingles, part keys for all others; sets between have both."""
    small = [prefix_keys(s)] if 4 * len(s) <= 5 * SMALL else []
    large = [part_keys(s)] if len(s) > SMALL else []
    return np.concatenate(small + large)


FEATURES = "keys array<long>, set_fp long, parity long, n long"


def features(text: bytes) -> tuple[np.ndarray, int, int, int]:
    """(keys, fingerprint, parities, size) of a text's shingle set."""
    s = shingle_set(text)
    return all_keys(s).view(np.int64), set_fingerprint(s), parity_bits(s), len(s)


PAIRS = "a long, b long, node_a long, node_b long"
FOUND = "key long, " + PAIRS  # key null: a pair; else a row (key, mark, node, fp, n) of an open key
ROWS = "key long, root long, mark long, node long, fp long, n long"


def _bounded(odd: np.ndarray, fp_a: np.ndarray, n_a: np.ndarray, fp_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits that differ, whether a pair lies within the bounds of bits and size); odd keys come with fingerprints, even ones with parities."""
    d = np.bitwise_count(fp_a ^ fp_b).astype(np.int16)
    return d, np.where(odd, d <= MOST_BITS, 9 * d <= n_a + n_b) & (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b))


def _ordered(mark_a: np.ndarray, mark_b: np.ndarray, node_a: np.ndarray, node_b: np.ndarray) -> np.ndarray:
    """Rows mark a, mark b, node a, node b with the smaller mark first."""
    turn = mark_a > mark_b
    return np.stack([np.where(turn, mark_b, mark_a), np.where(turn, mark_a, mark_b), np.where(turn, node_b, node_a), np.where(turn, node_a, node_b)])


def nearest_pairs(rows: np.ndarray, odd: int = 1) -> tuple[np.ndarray, bool]:
    """(mark a, mark b, node a, node b) of each text's nearest others of one key (rows mark, node, fp, n), and whether more are within the bounds."""
    out, more = [], rows.shape[1] > BLOCK
    mark, node, fp, n = rows
    f = fp.view(np.uint64)
    for at in range(0, len(mark), BLOCK):  # sorted by mark, so that blocks are the same in every run
        m, nodes, x, size = mark[at : at + BLOCK], node[at : at + BLOCK], f[at : at + BLOCK], n[at : at + BLOCK]
        if at and len(m) < 2:
            m, nodes, x, size = mark[at - 1 :], node[at - 1 :], f[at - 1 :], n[at - 1 :]
        d, left = _bounded(odd, x[:, None], size[:, None], x[None, :], size[None, :])
        left &= nodes[:, None] != nodes[None, :]
        d[~left] = 99
        for _ in range(min(NEAREST, len(m) - 1)):
            j = d.argmin(axis=1)
            i = np.arange(len(m))
            near = d[i, j] < 99
            a, b = i[near], j[near]
            out.append(_ordered(m[a], m[b], nodes[a], nodes[b]))
            d[i, j] = 99
            left[a, b] = left[b, a] = False
        more = more or bool(left.any())
    return np.unique(np.concatenate([np.zeros((4, 0), dtype=np.int64), *out], axis=1), axis=1), more


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, mark -> candidate pairs, and the rows of open keys."""
    parted = None  # the long key that goes on in blocks

    def found(rows: np.ndarray):
        key = rows[0]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = ends - starts
        two = starts[size == 2]
        ok = _bounded(key[two] & 1, rows[3, two].view(np.uint64), rows[4, two], rows[3, two + 1].view(np.uint64), rows[4, two + 1])[1]
        two = two[ok]
        pairs = [np.stack([rows[1, two], rows[1, two + 1], rows[2, two], rows[2, two + 1]])]
        stay = [rows[:, key == parted]] if parted is not None else []
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            some, more = nearest_pairs(rows[1:, s:e], key[s] & 1)
            pairs.append(some)
            if more and key[s] != parted:
                stay.append(rows[:, s:e])
        p = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(p.shape[1], pa.int64()), *(pa.array(c) for c in p)], names=["key", "a", "b", "node_a", "node_b"])
        if stay:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(stay, axis=1)], names=["key", "a", "b", "node_a", "node_b"])

    held = np.zeros((5, 0), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)])], axis=1)
        if not rows.shape[1]:
            continue
        last = rows[0] == rows[0, -1]
        if not last.all():
            yield from found(rows[:, ~last])
        held = rows[:, last]
        while held.shape[1] >= 2 * BLOCK:  # a long key goes on in blocks that share a text
            parted = held[0, 0]
            yield from found(held[:, :BLOCK])
            held = held[:, BLOCK - 1 :]
    if held.shape[1]:
        yield from found(held)


def across(rows: np.ndarray, every: bool, odd: int = 1, sketches: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs within the bounds across the roots of one key (rows root, mark, node, fp, n, sorted by root, and their folded sketches):
    all of them, or of each text those with its NEAREST others."""
    root, mark, node, fp, n = rows
    f = fp.view(np.uint64)
    blocks = [slice(at, min(at + BLOCK, len(root))) for at in range(0, len(root), BLOCK)]
    far = np.iinfo(np.int32).max

    def compared(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        d, ok = _bounded(odd, f[a, None], n[a, None], f[None, b], n[None, b])
        d = d.astype(np.int32)
        ok &= root[a, None] != root[None, b]
        if sketches is not None:
            i, j = np.nonzero(ok)
            for at in range(0, len(i), SKETCHED):
                x, y = i[at : at + SKETCHED], j[at : at + SKETCHED]
                d[x, y] = np.bitwise_count(sketches[a][x] ^ sketches[b][y]).sum(axis=1, dtype=np.int32)
            ok &= 9 * d <= n[a, None] + n[None, b]
        return d, ok

    for k, a in enumerate(blocks):
        least, at = np.full((a.stop - a.start, NEAREST), far, dtype=np.int32), np.zeros((a.stop - a.start, NEAREST), dtype=np.int64)
        for b in blocks[k:] if every else blocks:
            if root[min(a.start, b.start)] == root[max(a.stop, b.stop) - 1]:
                continue
            d, ok = compared(a, b)
            if every:
                i, j = np.nonzero(ok & (root[a, None] < root[None, b]))
                if len(i):
                    i, j = i + a.start, j + b.start
                    yield _ordered(mark[i], mark[j], node[i], node[j])
            elif ok.any():
                d[~ok] = far
                least, at = np.concatenate([least, d], axis=1), np.concatenate([at, np.broadcast_to(np.arange(b.start, b.stop), d.shape)], axis=1)
                best = np.argpartition(least, NEAREST - 1, axis=1)[:, :NEAREST]
                least, at = np.take_along_axis(least, best, axis=1), np.take_along_axis(at, best, axis=1)
        i, c = np.nonzero(least < far)
        if len(i):
            i, j = i + a.start, at[i, c]
            yield np.unique(_ordered(mark[i], mark[j], node[i], node[j]), axis=1)


def _across(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key, root, mark -> pairs across roots."""

        def found(rows: np.ndarray, sketches: list[bytes]):
            cut = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), rows.shape[1]], strict=True):
                if rows[1, s] != rows[1, e - 1]:
                    for p in across(rows[1:, s:e], every, rows[0, s] & 1, folded(sketches[s:e])):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in p], names=["a", "b", "node_a", "node_b"])

        held: list[np.ndarray] = []
        own: list[bytes] = []  # sketches of the rows held
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)])
            if not rows.shape[1]:
                continue
            own += batch.column(6).to_pylist()
            if rows[0, 0] == rows[0, -1] and held and held[0][0, 0] == rows[0, 0]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows], axis=1)
            start = int(np.searchsorted(rows[0], rows[0, -1]))  # sorted by key
            if start:
                yield from found(rows[:, :start], own[:start])
            held, own = [rows[:, start:]], own[start:]
        if held:
            yield from found(np.concatenate(held, axis=1), own)

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = [sketch(shingle_set(t.as_py())) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(sketches, pa.binary())], names=["mark", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(sets, pa.binary())], names=["mark", "s"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both) > 0)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("node_a").filter(keep), batch.column("node_b").filter(keep)], names=["a", "b"])


def _texts(marks: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """(mark, text) of those marks; more than once where rows repeat."""
    wanted = first.select("key_id", "key_mark").join(marks.select(F.col("mark").alias("key_mark")).distinct(), "key_mark", "left_semi")
    return rows.join(wanted, ["key_id", "key_mark"], "left_semi").select(F.col("key_mark").alias("mark"), "text")


def _checked(pairs: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of those pairs whose texts are similar."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("mark")), first, rows)
    sets = stage_table(map_arrow(texts, _sets, "mark long, s binary"), "sets")
    a, b = sets.select(F.col("mark").alias("a"), F.col("s").alias("sa")), sets.select(F.col("mark").alias("b"), F.col("s").alias("sb"))
    links = stage_table(map_arrow(pairs.join(a, "a").join(b, "b").select("node_a", "node_b", "sa", "sb"), _exact, "a long, b long"), "links")
    drop_stage(sets)
    return links


def similar_links(first: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """first(key_id, key_mark, node, keys, set_fp, parity, n), one row per different text, rows(key_id, key_mark, text) with those
    texts, and edges near(a, b) known before -> edges (a, b) that connect those and the nodes of similar texts."""
    keyed = first.select(F.explode("keys").alias("key"), F.col("key_mark").alias("mark"), "node", "set_fp", "parity", "n")
    keyed = keyed.select("key", "mark", "node", F.when(F.col("key").bitwiseAND(1) == 1, F.col("set_fp")).otherwise(F.col("parity")).alias("fp"), "n")
    raw = stage_table(map_arrow(keyed.repartition("key").sortWithinPartitions("key", "mark"), _paired, FOUND, rows=None), "found")
    checked = stage_table(raw.where("key is null and node_a <> node_b").drop("key").distinct(), "pairs")
    edges = near.union(_checked(checked, first, rows))
    still = raw.where("key is not null").select("key", F.col("a").alias("mark"), F.col("b").alias("node"), F.col("node_a").alias("fp"), F.col("node_b").alias("n"))
    if still.isEmpty():
        return edges
    roots = connected_components(edges)

    def placed() -> DataFrame:
        return still.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "mark", "node", "fp", "n")

    parted = placed().groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    still = stage_table(still.join(parted, "key", "left_semi").select(*still.columns), "open")
    if still.isEmpty():
        return edges
    sketches = stage_table(map_arrow(_texts(still.select("mark"), first, rows), _sketches, "mark long, sketch binary").dropDuplicates(["mark"]), "sketches")
    for every in (False, True):
        if roots is None:
            roots = connected_components(edges)
        sketched = placed().join(sketches, "mark").select("key", "root", "mark", "node", "fp", "n", "sketch")
        pairs = map_arrow(sketched.repartition("key").sortWithinPartitions("key", "root", "mark"), _across(every), PAIRS, rows=None)
        pairs = stage_table(pairs.distinct().join(checked, ["a", "b"], "left_anti").select("a", "b", "node_a", "node_b"), "pairs")
        if pairs.isEmpty():
            continue
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_checked(pairs, first, rows))
        checked, roots = checked.select("a", "b").union(pairs.select("a", "b")), None
    return edges
