"""Texts segmented by their own words and pairs of words, against trying every headword; odd separators, long words, repeated rows."""

import random
import re
from hashlib import md5

import duckdb
from pyspark.sql import functions as F

from tonglex.operators import own_phrases, segment
from tonglex.operators.own_phrases import phrase_digests
from tonglex.operators.segment import Segmenter
from tonglex.plans import text_queries

DATA = "/root/testdata/sf0.001"


def slow(rows, most):
    keys = set()
    for _, t in rows:
        ws = re.findall(r"[^ \n\t]+", t or "")
        keys |= {" " + w for w in ws} | {f" {a} {b}" for a, b in zip(ws, ws[1:], strict=False)}
    walk, out = Segmenter({k for k in keys if len(k) <= most}), []
    for i, t in rows:
        ts = walk.tokens(t) or []
        if ts:
            out.append((i, len(ts), sum(map(len, ts)), sum(int(md5(f"{k}:{x}".encode()).hexdigest()[:8], 16) for k, x in enumerate(ts))))
    return sorted(out, key=str)


def texts(rng, letters, n):
    words = ["".join(rng.choices(letters, k=rng.choice([1, 1, 2, 2, 3, 4, 5, 8, 17]))) for _ in range(60)]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\n", "  ", "\t", " \n", "\r"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_equal_to_trying_every_headword(spark):
    rng = random.Random(5)
    odd = [None, "", " ", "\n", " a", "a ", "a", "a b", " a b", "  a  b ", "\t\n", " " + "x" * 40, "x" * 40 + " a", " a " + "x" * 40, " aa b \x00 c\x00", "🙂 🙂🙂 中文中文中文中文中文 中文 é é"]
    for letters in ("ab", "abé", "中文a🙂", "ab \x0b\x00"):
        rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts(rng, letters, 120), *odd])]
        rows += [(5, rows[5][1])] * 4
        df = spark.createDataFrame(rows, "id long, t string").repartition(3)
        for most in (16, 5):
            want = slow(rows, most)
            assert len(want) > 100
            got = phrase_digests(df, "id", F.col("t"), most, 1000 if most == 5 else own_phrases.SLICE_BYTES)  # few texts, or many, together
            assert sorted(map(tuple, got.collect()), key=str) == want
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb")], "id long, t string")
    assert phrase_digests(nothing, "id", F.col("t"), 16).isEmpty() and phrase_digests(nothing.where("false"), "id", F.col("t"), 16).isEmpty()


def test_the_query_sends_what_texts_do_not_decide(spark, monkeypatch):
    """Only some of the words ask; the table of all headwords is not matched with all places."""
    monkeypatch.setattr(segment, "longest_matches", None)
    got = sorted(map(tuple, text_queries.tokenize_phrases(spark, DATA).collect()))
    t = spark.read.parquet(f"{DATA}/documents.parquet").select("text").toArrow().column("text").combine_chunks()
    words = own_phrases.Words.of(t)
    assert 0 < len(words.asking(15)) < len(words.start) / 3
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    assert got == sorted(con.sql(text_queries.TEXT["tokenize_phrases"][1]).fetchall())
