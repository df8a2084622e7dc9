"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id long, text string) of a documents table, with null texts as empty ones.

    Every other column is left behind, so extra columns cannot clash with an operator's own.
    """
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where a local session names none (tests). Raises on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tonglex-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, outlives lost executors.

    The files are removed by drop_stage, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage table that nothing reads any more."""
    path = df._stage_path
    _WRITTEN.remove((df.sparkSession, path))
    _delete(df.sparkSession, path)


def written() -> int:
    """How many stage tables there are, for settled()."""
    return len(_WRITTEN)


def written_folder(spark: SparkSession, path: str) -> None:
    """A folder of an operator's own files, deleted as stage tables are."""
    _WRITTEN.append((spark, path))


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df as a stage table, in place of those written after the first `since`."""
    out = stage_table(df, name)
    for spark, path in _WRITTEN[since:-1]:
        _delete(spark, path)
    del _WRITTEN[since:-1]
    return out


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_forget)


def _released() -> None:
    """Give freed memory back to the system: a worker that is kept for later tasks would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


SLICE_BYTES = 16 << 20


def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most SLICE_BYTES, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half))
        yield from halved(batch.slice(half))
    else:
        yield batch


def map_arrow(df: DataFrame, run, schema, rows: int | None = 1024) -> DataFrame:
    """df.mapInArrow(run, schema) on slices of at most `rows` rows and, but for single ones, SLICE_BYTES (None: batches as they come), giving memory back at the end."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows):
                yield from halved(batch.slice(at, rows))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches) if rows else batches)
        finally:
            _released()

    return df.mapInArrow(frugal, schema)


NO_ID = -(1 << 63)  # stands for a null doc_id, before all others


def row_key(docs: DataFrame) -> list:
    """Columns that tell documents apart: the id, and a hash of the text should ids repeat. Never null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key_mark")]


def with_rows(docs: DataFrame, keys: DataFrame, how: str, single: bool = False) -> DataFrame:
    """The rows of docs whose row_key is (left_semi) or isn't (left_anti) in keys; single: equal rows only once."""
    d = docs.select(F.struct("*").alias("row"), *row_key(docs)).join(keys, ["key_id", "key_mark"], how)
    if single:
        d = d.groupBy("key_id", "key_mark").agg(F.first("row").alias("row"))
    return d.select("row.*")


BROADCAST_ROWS, BROADCAST_BYTES, HOT = 200_000, 16 << 20, 1000


def with_totals(df: DataFrame, totals: DataFrame, key: str, spread, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, left-joined to what is known of each key: totals(key, n rows of df, ...); a null key is a key. `n` is left out.

    totals of a checked size are broadcast. Of larger ones only keys of over 1 / HOT of the rows (fewer than HOT of them) are;
    other keys meet by shuffle, where rows of the former are dealt out by `spread`, so that no key gathers its rows in one task.
    """
    rest = [c for c in totals.columns if c not in (key, "n")]
    named = lambda t: t.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in rest))
    size, length, rows = totals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= most_rows and length <= BROADCAST_BYTES:
        out = df.join(F.broadcast(named(totals)), F.col(key).eqNullSafe(F.col("_key")), "left")
        return out.select(*df.columns, *(F.col(f"_{c}").alias(c) for c in rest))
    hot, cold = totals.where(F.col("n") * HOT > rows), totals.where(F.col("n") * HOT <= rows)
    first = named(hot).withColumn("_hot", F.lit(1))
    out = df.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    out = out.withColumn("_at", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(HOT))).cast("int"))
    out = out.select(*df.columns, "_at", *(F.col(f"_{c}").alias(f"_hot_{c}") for c in rest))
    second = named(cold).withColumn("_to", F.lit(0))
    out = out.join(second, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_to")), "left")
    return out.select(*df.columns, *(F.coalesce(f"_hot_{c}", f"_{c}").alias(c) for c in rest))
