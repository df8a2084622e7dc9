"""A corpus pipeline of training-data operators: rules, near copies, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonglex.llm.common import NO_ID, stage_table, table, with_rows
from tonglex.llm.decontamination import contaminated
from tonglex.llm.packing import pack
from tonglex.llm.quality_rules import keep_good
from tonglex.llm.secret_scan import redact_secrets
from tonglex.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; the others go."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    keys = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.col("mark").alias("key_mark")).distinct()
    return with_rows(docs, keys, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Fingerprint components, latent retrieval and tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on `documents`, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
