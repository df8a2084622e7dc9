"""Vector code compression: product codes whose nearest entries are screened in float32 and settled in integers.

Components become integers and vectors equal parts, each with a codebook of its own. A float32 matrix product
gives ||c||^2 - 2 x.c for all entries of a part at once, with an interval that holds the true value: rounding the
d factors, products and sums moves it by at most (d + 8) u (||c||^2 + 2 ||x|| ||c||), u = 2^-24. Entries whose
interval overlaps the best one's are measured again in int64; of equal distances the lowest index wins.

Codebooks are fitted as Spark jobs: every task sums the parts of each entry, Spark adds the sums up, and the
codebooks (parts x entries x width, whatever the number of vectors) go back to the tasks of the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, map_arrow, settled, stage_table, table, with_totals, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
UNIT = 2.0**-24  # float32 rounding


def _integers(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(int32 little-endian components of each kept vector, places of kept vectors)."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    x, rows = flat.fill_null(np.nan).to_numpy(zero_copy_only=False), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), dtype=bool)
    bad[rows[~np.isfinite(x)]] = True
    bad |= column.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)[~bad]
    most = _most(max(int(lengths.max(initial=0)), 1))
    with np.errstate(over="ignore"):
        v = np.clip(np.floor(SCALE * x[~bad[rows]]), -most, most).astype("<i4")
    ends = (4 * np.concatenate([[0], np.cumsum(lengths)])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(v.tobytes())]), np.flatnonzero(~bad)


def _most(width: int) -> int:
    """Greatest component of which `width` squared differences still add up to a long."""
    return min((1 << 31) - 1, int((2.0**62 / width) ** 0.5) // 2)


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """parts x vectors x width of a part, int64; shorter vectors as if zeros followed."""
    data = column.to_pylist()
    if any(len(b) != 4 * width for b in data):
        data = [b.ljust(4 * width, b"\0") for b in data]
    return np.frombuffer(b"".join(data), dtype="<i4").reshape(len(data), parts, width // parts).astype(np.int64).transpose(1, 0, 2)


def overlapping(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """vectors x entries: whether the entry's float32 interval overlaps the best one's, so that it may be the nearest."""
    c2 = (entries * entries).sum(axis=1)
    near = (c2.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)).astype(np.float64)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    width = 1.01 * (x.shape[1] + 8) * UNIT * (c2[None, :] + 2 * norms[:, None] * np.sqrt(c2.astype(np.float64))[None, :])
    return near - width <= (near + width).min(axis=1)[:, None]


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the entry nearest to each vector (int64 both), the lowest of equal ones."""
    may = overlapping(x, entries)
    out = may.argmax(axis=1)
    open_ = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_):
        row, entry = np.nonzero(may[open_])
        exact = ((x[open_[row]] - entries[entry]) ** 2).sum(axis=1)
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best = np.repeat(np.minimum.reduceat(exact, heads), np.diff(np.append(heads, len(row))))
        hits = np.flatnonzero(exact == best)
        first = hits[np.concatenate([[True], row[hits][1:] != row[hits][:-1]])]
        out[open_] = entry[first]
    return out


def _sums(books: np.ndarray, width: int) -> callable:
    """Each task's componentwise sums and counts of the parts nearest to every entry."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, d), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch.column("vector"), width, parts)):
                code = nearest(x, books[p])
                counts[p] += np.bincount(code, minlength=k)
                for e in np.unique(code).tolist():
                    sums[p, e] += x[code == e].sum(axis=0)
        p, e = np.nonzero(counts)
        place = np.tile(np.arange(d), len(p))
        cols = [np.repeat(p * k + e, d), place, sums[p, e].ravel(), np.repeat(counts[p, e], d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["entry", "place", "total", "n"])

    return run


def fit_codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width: from the vectors of the smallest ids (nulls last), each round every entry becomes the floored
    mean of the parts nearest to it. Only sums per entry come to the driver."""
    first = pa.array([bytes(r["vector"]) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()], pa.binary())
    books = _parts(first, width, parts).copy()
    for _ in range(rounds):
        found = map_arrow(kept.select("vector"), _sums(books, width), "entry long, place long, total long, n long")
        for r in found.groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["entry"] // books.shape[1], r["entry"] % books.shape[1], r["place"]] = r["total"] // r["n"]
    return books


def _code(books: np.ndarray, width: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _parts(batch.column("vector"), width, len(books))
            codes = np.empty((batch.num_rows, len(books)), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for p, own in enumerate(x):
                codes[:, p] = nearest(own, books[p])
                error += ((own - books[p][codes[:, p]]) ** 2).sum(axis=1)
            digits, size = codes.tobytes().hex(), 2 * len(books)
            code = pa.array([digits[i : i + size] for i in range(0, len(digits), size)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **bounds) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every kept row.

    Defined results: rows whose vector is null or holds a null or non-finite component go; shorter vectors, and those of a
    length that `parts` does not divide, count as if zeros followed, up to the greatest length; components are held to the
    bound within which errors fit a long (over 32,000 for 64 dimensions); null vec_ids come last in order, null labels are
    one label; repeated rows stay; fewer vectors than `entries` give as many entries; an empty table gives an empty result;
    other columns are ignored. `entries` is at most 256. bounds: those of with_totals.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark, since = vectors.sparkSession, written()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector, at = _integers(batch.column("vector"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), vector], names=["vec_id", "label", "vector"])

    kept = stage_table(map_arrow(v, clean, T.StructType([v.schema["vec_id"], v.schema["label"], T.StructField("vector", T.BinaryType())])), "vectors")
    longest = kept.agg(F.max(F.octet_length("vector"))).first()[0]
    if longest is None:
        drop_stage(kept)
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(-(-longest // 4 // parts), 1) * parts
    books = fit_codebooks(kept, width, parts, entries, rounds)
    coded = map_arrow(kept, _code(books, width), T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    coded = settled(coded, "codes", since)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_totals(coded, totals, "label", F.col("vec_id"), **bounds).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        ctes.append(f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(apart := {apart}, e := e)) AS best FROM parts JOIN c{k} USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            ctes.append(f"s{k} AS MATERIALIZED (SELECT p, e, j, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT p, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY ALL)")
            ctes.append(f"m{k} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{k} GROUP BY p, e)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.p = m{k}.p AND c{k}.e = m{k}.e)")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.apart)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"


ORACLE_SQL = _oracle()
