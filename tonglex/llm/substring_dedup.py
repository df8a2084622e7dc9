"""Removal of repeated byte strings of a fixed length, by suffix sorting of what can repeat.

1. Every document is cut into cells of windows around content-defined anchors. Equal windows have
   equal anchors, and cells that are equal as wholes are settled by their hashes: all but the
   first are repeats.
2. Of the distinct cells that are left, only windows whose core of bytes another cell of the same
   anchor has too can repeat. These are dealt into shards by anchor, so that equal windows meet.
3. Each shard's cells are suffix-sorted by external induction (see induced.py); where neighbours
   share a whole window, all but the first are repeats.
4. Repeats go back to their documents, whose covered bytes are taken out.

Texts travel only in steps 3 and 4, by their own key; the many cells of a hot text are settled
within each batch before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import cell_type, cells, ranges
from .common import NO_ID, docs_of, map_arrow, stage_table, table
from .induced import falling_suffixes

LENGTH = 100
BUCKET_BYTES = 8 << 20  # of input for each shard
PLACE = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("start", "<u4"), ("n", "<u2")])
PACKED = "bucket int, blob binary, text binary, doc long, tag int, start long, n long, repeat boolean"


def _packed(bucket=(), blob=(), text=(), doc=(), tag=(), start=(), n=(), repeat=()) -> pa.RecordBatch:
    """Columns of PACKED; those not given are null."""
    size = max(map(len, (bucket, blob, doc)))
    kinds = {"bucket": pa.int32(), "blob": pa.binary(), "text": pa.binary(), "doc": pa.int64(), "tag": pa.int32(), "start": pa.int64(), "n": pa.int64(), "repeat": pa.bool_()}
    given = {"bucket": bucket, "blob": blob, "text": text, "doc": doc, "tag": tag, "start": start, "n": n, "repeat": repeat}
    cols = [pa.array(given[c], k) if len(given[c]) or not size else pa.nulls(size, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays(cols, names=list(kinds))


def _settled(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells sorted by content -> (those at their content's first place, each once, and repeats of these)."""
    c = c[np.lexsort((c["tag"], c["start"], c["doc"], c["cell"], c["anchor"]))]
    new = np.concatenate([[True], (c["cell"][1:] != c["cell"][:-1]) | (c["anchor"][1:] != c["anchor"][:-1])])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (c["doc"] == c["doc"][least]) & (c["start"] == c["start"][least])
    again = np.concatenate([[False], ~new[1:] & (c["doc"][1:] == c["doc"][:-1]) & (c["start"][1:] == c["start"][:-1]) & (c["tag"][1:] == c["tag"][:-1])])
    return c[first & ~again], c[~first & ~again]


def _cells_of(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for i, t in enumerate(batch.column("text").cast(pa.binary())):
                c = cells(t.as_py(), length)
                if len(c):
                    c["doc"], c["tag"] = docs[i], tags[i]
                    parts.append(c)
            if not parts:
                continue
            kept, repeats = _settled(np.concatenate(parts))
            del parts
            bucket = (kept["anchor"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            kept, bucket = kept[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield _packed(bucket=bucket[cut], blob=[kept[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(kept)), strict=True)])
            if len(repeats):
                spread = ((repeats["doc"] + repeats["start"]) % buckets).astype(np.int32)  # nothing is to meet here
                yield _packed(bucket=spread, doc=repeats["doc"], tag=repeats["tag"], start=repeats["start"].astype(np.int64), n=repeats["n"].astype(np.int64), repeat=np.ones(len(repeats), bool))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], passed: list | None = None) -> Iterator[tuple[int, list]]:
    """(bucket, its (blob, text) rows) of a partition sorted by bucket; rows without a blob go to `passed` as batches."""
    at, held = None, []
    for batch in batches:
        blobs = batch.column("blob")
        if passed is not None:
            rest = batch.filter(blobs.is_null())
            if rest.num_rows:
                passed.append(rest)
            batch = batch.filter(blobs.is_valid())
        for b, blob, text in zip(batch.column("bucket").to_pylist(), batch.column("blob"), batch.column("text"), strict=True):
            if b != at:
                if held:
                    yield at, held
                at, held = b, []
            held.append((blob.as_py(), text.as_py()))
        if passed:
            yield -1, []
    if held:
        yield at, held


def _in_common(c: np.ndarray, length: int) -> np.ndarray:
    """PLACE rows for those windows of distinct cells (sorted by anchor) whose core another cell of the anchor has too."""
    parts = []
    offset, n = c["offset"].astype(np.int64), c["n"].astype(np.int64)
    for r, (low, high) in enumerate(ranges(length)):
        core = c["cores"][:, r]
        order = np.lexsort((core, c["anchor"]))
        x, a = core[order], c["anchor"][order]
        same = (x[1:] == x[:-1]) & (a[1:] == a[:-1]) & (x[1:] != 0)
        shared = np.zeros(len(c), dtype=bool)
        shared[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = np.flatnonzero(shared)
        # windows start where the anchor is `high` to `low` bytes on
        first, last = np.maximum(offset[at] - high, 0), np.minimum(offset[at] - low, n[at] - 1)
        parts.append(np.stack([at, first, last + 1]))
    at, first, end = np.concatenate(parts, axis=1)
    order = np.lexsort((first, at))
    at, first, end = at[order], first[order], end[order]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != end[:-1])]) if len(at) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    ends = end[np.append(heads[1:], len(at)) - 1] if len(at) else end
    out = np.empty(len(heads), dtype=PLACE)
    rows = c[at[heads]]
    out["doc"], out["tag"], out["start"], out["n"] = rows["doc"], rows["tag"], rows["start"] + first[heads], ends - first[heads]
    return out


def _repeated_cells(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells by bucket -> repeats, and what the distinct cells of an anchor may have in common."""
        passed: list[pa.RecordBatch] = []
        for bucket, rows in _grouped(batches, passed):
            yield from passed
            passed.clear()
            if not rows:
                continue
            kept, repeats = _settled(np.concatenate([np.frombuffer(b, dtype=cell_type(length)) for b, _ in rows]))
            for c, repeat in ((repeats, True), (_in_common(kept, length), False)):
                if len(c):
                    yield _packed(bucket=np.full(len(c), bucket, dtype=np.int32), doc=c["doc"], tag=c["tag"], start=c["start"].astype(np.int64), n=c["n"].astype(np.int64), repeat=np.full(len(c), repeat))
        yield from passed

    return run


def _cut_cells(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with lists of cells -> the cells' bytes, packed by bucket."""
        for batch in batches:
            by: dict[int, list] = {}
            for doc, tag, text, listed in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("cells").to_pylist(), strict=True):
                t = text.as_py()
                for c in listed:
                    by.setdefault(c["bucket"], []).append((doc, tag, c["start"], c["n"], t[c["start"] : c["start"] + c["n"] + length - 1]))
            if by:
                yield _packed(
                    bucket=list(by),
                    blob=[np.array([x[:4] for x in v], dtype=PLACE).tobytes() for v in by.values()],
                    text=[b"\xff".join([*(x[4] for x in v), b""]) for v in by.values()],
                )

    return run


def repeated_windows(place: np.ndarray, text: bytes, length: int, memory: int = 64 << 20) -> np.ndarray:
    """Cells (PLACE rows, and their bytes each followed by 0xFF) -> PLACE rows of the windows that also start earlier, in runs."""
    size = place["n"].astype(np.int64) + length  # with the separator
    at = np.cumsum(size) - size
    order = np.lexsort((place["start"], place["doc"]))
    raw = np.frombuffer(text, dtype=np.uint8)
    place, size, at = place[order], size[order], at[order]
    new_at = np.cumsum(size) - size
    # UTF-8 has no 0xFF, so that separators become 0 and all else is larger
    t = raw[np.repeat(at - new_at, size) + np.arange(len(raw))] + np.uint8(1)
    inside = np.arange(len(t)) - np.repeat(new_at, size) < np.repeat(place["n"], size)
    found, groups, group = [], [], 0
    for pos, lcp in falling_suffixes(t, length, memory):
        g = group + np.cumsum(lcp < length)
        group = int(g[-1])
        v = inside[pos]
        found.append(pos[v])
        groups.append(g[v])
    pos, g = np.concatenate(found).astype(np.int64), np.concatenate(groups)
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    several = np.diff(np.append(starts, len(g)))
    least = np.repeat(np.minimum.reduceat(pos, starts), several)
    pos, least = pos[pos != least], least[pos != least]
    c, d = np.searchsorted(new_at, pos, side="right") - 1, np.searchsorted(new_at, least, side="right") - 1
    start, start_least = place["start"][c] + (pos - new_at[c]), place["start"][d] + (least - new_at[d])
    later = (place["doc"][c] != place["doc"][d]) | (start != start_least)
    pos, c, start = pos[later], c[later], start[later]
    order = np.argsort(pos)
    pos, c, start = pos[order], c[order], start[order]
    heads = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (c[1:] != c[:-1])])) if len(pos) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(heads), dtype=PLACE)
    out["doc"], out["tag"], out["start"], out["n"] = place["doc"][c[heads]], place["tag"][c[heads]], start[heads], np.diff(np.append(heads, len(pos)))
    return out


def _sorted_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            place = np.concatenate([np.frombuffer(b, dtype=PLACE) for b, _ in rows])
            r = repeated_windows(place, b"".join(t for _, t in rows), length)
            if len(r):
                yield _packed(doc=r["doc"], tag=r["tag"], start=r["start"].astype(np.int64), n=r["n"].astype(np.int64), repeat=np.ones(len(r), bool))

    return run


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows that start in [start, start + count)."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], starts[order] + counts[order] + length - 1
    end = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > end[:-1]])
    heads = np.flatnonzero(new)
    return a[heads], end[np.append(heads[1:], len(a)) - 1]


def _taken_out(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, listed in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
                t, spans, removed = text.as_py(), 0, 0
                kept = t
                if listed.is_valid and len(listed.values):
                    v = listed.values
                    a, b = covered(v.field("start").to_numpy(zero_copy_only=False), v.field("n").to_numpy(zero_copy_only=False), length)
                    spans, removed = len(a), int((b - a).sum())
                    kept = b"".join(t[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)], strict=True))
                rows.append((doc, len(t), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            cols = list(zip(*rows, strict=True)) or [()] * (6 if texts else 5)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, buckets: int | None = None, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 per input row, with `texts` also the kept bytes.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or earlier
    in the same document. Defined results: a null or empty text has no bytes; a null doc_id comes before all others;
    rows that repeat a doc_id are one document each, and strings at equal places of them are not earlier than one
    another; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.hash("text").alias("tag"), "text")
    if buckets is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = min(1 << 30, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    c = map_arrow(d, _cells_of(length, buckets), PACKED, rows=2048).repartition("bucket").sortWithinPartitions("bucket")
    c = stage_table(map_arrow(c, _repeated_cells(length), PACKED, rows=None).select("bucket", "doc", "tag", "start", "n", "repeat"), "cells")
    shared = c.where("not repeat").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "bucket")).alias("cells"))  # of one document
    s = map_arrow(d.join(shared, ["doc", "tag"]).select("doc", "tag", "text", "cells"), _cut_cells(length), PACKED)
    s = s.select("bucket", "blob", "text").repartition("bucket").sortWithinPartitions("bucket")
    s = stage_table(map_arrow(s, _sorted_shards(length), PACKED, rows=None).select("doc", "tag", "start", "n"), "windows")
    spans = c.where("repeat").select("doc", "tag", "start", "n").union(s).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = map_arrow(d.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans"), _taken_out(length, texts), RESULT + ", kept binary" * texts)
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), *out.columns[1:])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
