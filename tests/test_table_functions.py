"""Table functions: rows, columns that follow from the table, and what is refused."""

import pytest
from pyspark.errors import AnalysisException

from tonglex import sql
from tonglex.operators.lookup import query_by_chinese, query_by_english
from tonglex.operators.segment import Segmenter
from tonglex.operators import table_functions
from tonglex.sources.lexicon import seed

TEXTS = ["今天天气挺爽", None, "", "x", "西瓜" * 3000, "執行xxx人們", "执行", "Today, watermelon"]


@pytest.fixture(scope="module")
def lexicon(spark):
    x = seed(spark)
    sql.register(spark, x, "tf_")
    rows = [(str(i), t, i, i) for i, t in enumerate(TEXTS)] + [(None, "西瓜", 1, 100), ("6", "执行", 1, 101)]
    spark.createDataFrame(rows, "`a name` string, text string, token long, more long").createOrReplaceTempView("tf_texts")
    return x


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_rows_of_tokens(spark, lexicon):
    walk = Segmenter([r["key"] for r in lexicon.headwords.collect()])
    texts = [(r["a name"], r["text"]) for r in spark.table("tf_texts").collect()]
    want = sorted(str((i, k, w)) for i, t in texts for k, w in enumerate(walk.tokens(t) or ()))
    got = spark.sql("SELECT * FROM tf_token_rows(TABLE(tf_texts), 'a name', 'text')")
    assert got.dtypes == [("a name", "string"), ("tok_pos", "int"), ("first", "int"), ("end", "int"), ("token", "string")]
    assert rows(got.select("a name", "tok_pos", "token")) == want
    spans = spark.sql("SELECT substring(t.text, s.first + 1, s.end - s.first) = s.token AS same FROM tf_token_rows(TABLE(tf_texts), 'more', 'text') s JOIN tf_texts t USING (more)")
    assert spans.where("not same or same is null").count() == 0
    assert spark.sql("SELECT * FROM tf_token_rows(TABLE(SELECT * FROM tf_texts WHERE false), 'a name', 'text')").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    large = spark.range(20_000).selectExpr("id", "'执行西瓜' AS text").coalesce(1)
    large.createOrReplaceTempView("tf_large")  # more than one pass
    assert spark.sql("SELECT count(*), count(DISTINCT id), sum(tok_pos) FROM tf_token_rows(TABLE(tf_large), 'id', 'text')").first() == (40_000, 20_000, 20_000)


def test_rows_of_hits(spark, lexicon):
    t = spark.table("tf_texts").withColumnRenamed("a name", "id")
    got = spark.sql("SELECT * FROM tf_hit_rows(TABLE(tf_texts), 'a name', 'text')")
    assert rows(got) == rows(query_by_chinese(t, "id", "text", lexicon))
    english = spark.sql("SELECT * FROM tf_hit_rows(TABLE(SELECT `a name`, lower(tf_normalize(text)) AS g FROM tf_texts), 'a name', 'g', 'english')")
    assert rows(english) == rows(query_by_english(t, "id", "text", lexicon)) != []


@pytest.mark.parametrize(
    "call", ["tf_token_rows(TABLE(tf_texts), 'a name', 'nothing')", "tf_token_rows(TABLE(tf_texts), 'token', 'text')", "tf_token_rows(TABLE(tf_texts), 'a name', 'more')", "tf_hit_rows(TABLE(tf_texts), 'a name', 'text', 'latin')"]
)
def test_refused(spark, lexicon, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}")
