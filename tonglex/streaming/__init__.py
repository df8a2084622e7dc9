"""Text functions on streams: with a static lexicon, or with a store whose current version may change while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonglex.functions.text import classify_normal, normalize
from tonglex.operators.lookup import english_hits, query
from tonglex.sources.lexicon import Lexicon, current_version
from tonglex.sources.staged import create_text, names_in, read_text


def classified(stream: DataFrame, text: str) -> DataFrame:
    """The stream with the columns norm and label."""
    return stream.withColumn("norm", normalize(F.col(text))).withColumn("label", classify_normal(F.col("norm")))


def english_lookup(stream: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """The stream with a column hits; no state is kept."""
    return stream.withColumn("hits", english_hits(normalize(F.col(text)), lexicon))


def version_of_batch(spark: SparkSession, store: str, log: str, batch: int) -> str:
    """The lexicon version of a micro-batch: the current one when it first runs, and the same whenever it runs again."""
    name = f"{log}/batch-{batch}"
    if f"batch-{batch}" not in names_in(spark, log):
        version = current_version(spark, store)
        if version is None:
            raise FileNotFoundError(f"no lexicon in {store}")
        create_text(spark, name, version)
    return read_text(spark, name)


def answered(stream: DataFrame, doc: str, text: str, store: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Query a stream's texts with the store's version that is current when each micro-batch starts; rows go to `out` as Parquet,
    with the columns version and batch.

    A batch that runs again after a failure takes the version it took before and replaces its own rows, so none is lost or doubled.
    options: of the stream writer (trigger).
    """
    known: dict[str, Lexicon] = {}

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = version_of_batch(spark, store, f"{checkpoint}/versions", number)
        if version not in known:
            for old in known.values():
                old.release()
            known.clear()
            known[version] = Lexicon.read(spark, store, version=version)
        found = query(batch, doc, text, known[version]).withColumn("version", F.lit(version))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(**options) if options else writer).start()
