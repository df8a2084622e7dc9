"""Lexicons laid out by key: the same hits, and plans without an exchange on the index side."""

import re

import pytest
from pyspark.sql import functions as F

from tonglex.operators import prefixes
from tonglex.operators.keyed import KeyedLexicon, lay_out
from tonglex.operators.lookup import query, query_by_chinese, query_by_english, query_by_pinyin, query_by_simplified, with_entries
from tonglex.sources.lexicon import Lexicon, seed

TEXTS = [None, "", "今天天气挺爽", "执行xxx人們", "Today, the WATERMELON!", "to run to run", "xi1 gua1 nǐ hǎo", "萬万", "?!", "西瓜", "西瓜", "A cold, cold community."]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    seed(spark).write(path)
    lay_out(spark, path, buckets=3)
    return path


@pytest.fixture(scope="module")
def keyed(spark, store):
    x = KeyedLexicon.open(spark, store)
    x.broadcast_rows = 0
    return x


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i if i != 9 else None, t) for i, t in enumerate(TEXTS)], "id long, t string")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_keyed_lookups_equal_plain_ones(spark, df, keyed):
    plain = seed(spark)
    assert sorted(r["key"] for r in keyed.headwords.collect()) == sorted(r["key"] for r in plain.headwords.collect())
    for find in (query_by_chinese, query_by_english, query_by_pinyin, query_by_simplified):
        assert rows(find(df, "id", "t", keyed)) == rows(find(df, "id", "t", plain)), find
    for entries in (False, True):
        assert rows(query(df, "id", "t", keyed, entries)) == rows(query(df, "id", "t", plain, entries))
    keyed.check()
    none = df.where("false")
    assert query(none, "id", "t", keyed).count() == query_by_english(none, "id", "t", keyed).count() == 0


def test_a_small_keyed_lexicon_goes_to_the_tasks(spark, df, store):
    x = KeyedLexicon.open(spark, store)
    got = query(df, "id", "t", x)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(query(df, "id", "t", seed(spark)))


def exchanged_scans(plan: str) -> set[str]:
    """Names of the bucketed tables that are read below an exchange, by the depth of the lines of a plan."""
    out, path = set(), []
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+\-]*", line).group())
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if (found := re.search(r"lexicon_by_key_\w+?_(prints_\w+|entries|chinese|english|pinyin|simplified)\[", line)) and any("Exchange" in x for _, x in path):
            out.add(found.group(1))
    return out


def test_no_exchange_on_the_side_of_the_index(spark, df, keyed, monkeypatch):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        seen = keyed.part("pinyin").groupBy("word_id").count()._jdf.queryExecution().executedPlan().toString()
        assert exchanged_scans(seen) == {"pinyin"}  # the check sees one where there is one
        many = spark.range(40).select("id", F.lit("西瓜").alias("t")).unionByName(df)
        for hot in (prefixes.HOT, 1):  # the second: nothing is hot
            monkeypatch.setattr(prefixes, "HOT", hot)
            plans = [find(many, "id", "t", keyed) for find in (query_by_chinese, query_by_pinyin, query_by_simplified)]
            plans += [with_entries(spark.range(5).withColumnRenamed("id", "word_id"), keyed), keyed.headwords]
            for got in plans if hot == 1 else plans[3:]:
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert "lexicon_by_key" in plan and "Bucketed: true" in plan and not exchanged_scans(plan), plan
        monkeypatch.setattr(prefixes, "HOT", 500)
        assert rows(query_by_chinese(many, "id", "t", keyed)) == rows(query_by_chinese(many, "id", "t", seed(spark)))  # a hot token
        wrong = spark.createDataFrame([(1, 2)], "hi long, lo long").join(keyed.to_match("english").own, ["hi", "lo"], "left_anti")
        assert not exchanged_scans(wrong._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_kind_of_keys_is_written_by_many_tasks(spark, tmp_path):
    few = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}  # of so small a table
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        x = seed(spark)
        scans = x.index._jdf.queryExecution().executedPlan().toString().count("Scan")
        assert scans == 1  # entries are read once for all kinds
        name = x.write(str(tmp_path))
        back = Lexicon.read(spark, str(tmp_path))
        for kind in ("english", "traditional"):
            assert back.part(kind).select(F.input_file_name().alias("f")).distinct().count() > 1
        assert rows(back.index) == rows(x.index) and back.index.columns == x.index.columns, name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_layouts_belong_to_versions(spark, df, tmp_path):
    path = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        lay_out(spark, path)
    first = seed(spark)
    old = first.write(path)
    with pytest.raises(FileNotFoundError):
        KeyedLexicon.open(spark, path)
    n = lay_out(spark, path)
    assert lay_out(spark, path) == n  # once only
    Lexicon.of(first.entries.where("word_id > 5")).write(path)
    with pytest.raises(FileNotFoundError):
        KeyedLexicon.open(spark, path)  # the new version is not laid out yet
    x = KeyedLexicon.open(spark, path, old)
    assert x.entries.count() == first.entries.count()
    x.release()
    assert KeyedLexicon.open(spark, path, old).entries.count() == first.entries.count()  # found again from its files
    lay_out(spark, path, buckets=2)
    assert KeyedLexicon.open(spark, path).buckets == 2
