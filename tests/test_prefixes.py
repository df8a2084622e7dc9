"""Longest-match joins: long texts, many hits, tiny filters, hot tokens, rows without ids of their own."""

import random

import numpy as np
from pyspark.sql import functions as F

from tonglex.functions.spans import Filter, Spans, code_points
from tonglex.operators import prefixes
from tonglex.operators.lookup import query, query_by_english
from tonglex.operators.prefixes import hot_join, longest_matches
from tonglex.operators.segment import Segmenter, tokenize_join
from tonglex.sources.lexicon import Lexicon, seed

RNG = random.Random(8)


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_long_texts_and_repeated_rows(spark):
    keys = ["".join(RNG.choices("abc中", k=RNG.choice([1, 2, 3, 5, 9]))) for _ in range(60)] + ["", "a"]
    texts = [None, "", "zzz", "ab" * 10_000, "a" * 20_000, *("".join(RNG.choices("abc中 ", k=RNG.randint(0, 80))) for _ in range(40))]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3
    df = spark.createDataFrame(rows, "id long, t string")
    walk = Segmenter(keys)
    want = sorted(str((i, p, x)) for i, t in rows for p, x in enumerate(walk.tokens(t) or ()))
    got = tokenize_join(df, "id", "t", keyed(spark, keys))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    # filters of one word each let everything through; chunks of seven places cut every text; no mistakes allowed: the same rows by joins
    for how in ({"filter_bytes": 1}, {"filter_bytes": 1, "mistakes": 0, "chunk": 7}):
        other = longest_matches(df, "id", F.col("t"), keyed(spark, keys), **how)
        assert sorted(str((r["doc"], r["tok_pos"], r["key"])) for r in other.collect()) == want
    assert tokenize_join(df, "id", "t", keyed(spark, [])).isEmpty() and tokenize_join(df.where("false"), "id", "t", keyed(spark, keys)).isEmpty()


def test_many_mistakes_are_told_apart_by_filters(spark, monkeypatch):
    rng = random.Random(11)
    keys = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    walk = Segmenter(keys)
    want = sorted(str((i, p, x)) for i, t in enumerate(texts) for p, x in enumerate(walk.tokens(t)))
    monkeypatch.setattr(prefixes, "greedy_kept", None)  # places are not joined
    depth = []
    verdict = prefixes._verdict
    monkeypatch.setattr(prefixes, "_verdict", lambda *a: (depth.append(verdict(*a)), depth[-1])[1])
    for most in (1 << 20, 300, 20, 0):  # 11 bits a key: thousands of mistakes
        got = longest_matches(df, "id", F.col("t"), keyed(spark, keys), filter_bytes=1 << 12, mistakes=most)
        assert sorted(str((r["doc"], r["tok_pos"], r["key"])) for r in got.collect()) == want
    levels = [len(v.filters) for v in depth]
    assert levels == sorted(levels) and levels[0] == 0 and {n % 2 for n in levels[1:]} == {0, 1}, levels


def test_a_text_of_many_overlapping_hits(spark):
    n = 150_000
    df = spark.createDataFrame([(1, "abc" * (n // 3))], "id long, t string")
    plain = tokenize_join(df, "id", "t", keyed(spark, ["ab", "bc", "ca", "c"]))
    assert {r["token"]: r["count"] for r in plain.groupBy("token").count().collect()} == chain(n)
    got = longest_matches(df, "id", F.col("t"), keyed(spark, ["ab", "bc", "ca", "c"]), filter_bytes=1, mistakes=0)  # by joins
    assert {r["key"]: r["count"] for r in got.groupBy("key").count().collect()} == chain(n)
    assert got.agg(F.max("tok_pos"), F.countDistinct("tok_pos")).first() == (sum(chain(n).values()) - 1, sum(chain(n).values()))


def chain(n):
    """By walking: ab, ca, bc, ... over abcabc..."""
    text, at, out = "abc" * (n // 3), 0, {}
    while at < n:
        k = next((k for k in ("ab", "bc", "ca", "c") if text.startswith(k, at)), None)
        if k:
            out[k] = out.get(k, 0) + 1
        at += len(k or "x")
    return out


def test_filters_lose_nothing():
    keys = ["".join(RNG.choices("abcdef", k=RNG.randint(1, 9))) for _ in range(3000)]
    points, starts = code_points(keys)
    prints = Spans(points).part(0, starts[:-1], starts[1:])
    for most in (1, 1 << 10, 1 << 20):
        words = np.zeros(Filter.size(len(keys), most), dtype=np.uint64)
        for k in range(Filter.PROBES):
            word, bit = Filter.place(prints, k, len(words))
            np.bitwise_or.at(words, word, bit)
        assert len(Filter(words).found(prints)) == len(keys)
    other, ends = code_points([k + "x" for k in keys])
    assert len(Filter(words).found(Spans(other).part(0, ends[:-1], ends[1:]))) < 60  # of 3000 that are none


def test_hot_tokens_are_dealt_out(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("w"), F.col("id") % 700)).alias("token"))
    right = spark.createDataFrame([("the", 1), ("the", 2), ("w1", 3), ("w5", 4), ("zzz", 5)], "token string, word long")
    both = hot_join(left, "token", right, ["id"])
    assert sorted(map(tuple, both.select("id", "token", "word").collect())) == sorted(map(tuple, left.join(right, "token").select("id", "token", "word").collect()))
    tasks = both.where("token = 'the'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1 or both.rdd.getNumPartitions() == 1


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_small_lexicons_answer_without_exchange(spark):
    lexicon = seed(spark).warm()
    t = spark.createDataFrame([(1, "watermelon"), (None, "你好"), (1, "ni3 hao3"), (2, None)], "id long, t string")
    for entries in (False, True):
        assert exchanges(query(t, "id", "t", lexicon, entries)) == 0
    assert exchanges(query_by_english(t, "id", "t", lexicon)) == 0
    lexicon.release()
    assert query(t, "id", "t", Lexicon(lexicon.entries, lexicon.index)).count() == 4
