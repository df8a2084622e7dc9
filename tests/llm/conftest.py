import pytest


@pytest.fixture
def documents(spark):
    """(doc_id, text, lang, source, n_chars) from rows (doc_id, text), with extra columns of clashing names."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F

            for name in ("tag", "fp", "node", "row", "key_id", "mark", "words", "shard", "length", "start"):
                df = df.withColumn(name, F.lit(7))
        return df

    return make
