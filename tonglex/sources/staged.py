"""Tables written to the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where a local session names none (tests). Raises on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tonglex-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back. The files go when the driver's Python ends, or by dropped()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder of any file system that Spark reads; none if it is not there."""
    fs, p = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that is there as a whole or not at all; False if there is one of that name."""
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{p.getParent()}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        return False
    return True


def dropped(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        _WRITTEN.remove((df.sparkSession, df._staged))
        delete_folder(df.sparkSession, df._staged)


def delete_later(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's Python ends, as staged tables do."""
    _WRITTEN.append((spark, path))


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            delete_folder(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_forget)
