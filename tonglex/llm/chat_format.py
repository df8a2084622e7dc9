"""Chat formatting after cumulative-snapshot collapse, in built-in functions only.

A conversation is the set of its (turn, role, text) rows. Rolling hashes over its turns stand for
its prefixes: a 128-bit exclusive or of row hashes, so order within the sum does not matter and
long conversations are added up in chunks of turns. A conversation is logged again by a longer
one if more conversations have its hash as a prefix than have it as their whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CHUNK = 256
KEY = ["turn", "n", "x1", "x2"]


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no proper prefix of another; of equal ones the smallest conv_id."""
    t = _rows(conversations).select(
        "conv_id", "turn", F.xxhash64("turn", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role", "turn").alias("h2")
    ).distinct()
    t = t.groupBy("conv_id", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("c"))
    t = t.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    chunks = t.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"), F.sum("c").alias("cn"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        F.col("conv_id").alias("k_conv"), F.col("chunk").alias("k_chunk"),
        *(F.coalesce(f(x).over(before), F.lit(0)).alias(x) for f, x in ((F.bit_xor, "c1"), (F.bit_xor, "c2"), (F.sum, "cn"))),
    )
    upto = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    p = t.select("conv_id", "chunk", "turn", F.bit_xor("h1").over(upto).alias("l1"), F.bit_xor("h2").over(upto).alias("l2"), F.sum("c").over(upto).alias("ln"))
    p = p.join(chunks, p["conv_id"].eqNullSafe(F.col("k_conv")) & (p["chunk"] == F.col("k_chunk")))
    p = p.select("turn", (F.col("ln") + F.col("cn")).alias("n"), F.col("l1").bitwiseXOR(F.col("c1")).alias("x1"), F.col("l2").bitwiseXOR(F.col("c2")).alias("x2"))
    prefixes = p.groupBy(*KEY).agg(F.count("*").alias("n_prefix"))
    whole = t.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.sum("c").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n_turns"))
    whole = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_whole"), F.max("n_turns").alias("n_turns"))
    same = (whole["turn"] == prefixes["turn"]) & (whole["n"] == prefixes["n"]) & (whole["x1"] == prefixes["x1"]) & (whole["x2"] == prefixes["x2"])
    return whole.join(prefixes, same & (prefixes["n_prefix"] > whole["n_whole"]), "left_anti").select("conv_id", "n_turns")


def _plain(text: str, role: str) -> tuple[Column, Column]:
    """Text and role in which no marker can be read: a backslash goes between < and |, and in roles between | and >, and one more
    where there are some already, so that the first of them can be taken away again."""
    opened = lambda c: F.regexp_replace(c, r"<(\\*\|)", r"<\\$1")
    return opened(text), F.regexp_replace(opened(role), r"\|(\\*>)", r"|\\$1")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, n_turns, rendered: a row per turn of each maximal conversation.

    Turns stay rows, so that no conversation has to fit into one; joined in order of turn and rendered they are the
    formatted chat. Markers in texts and roles are escaped, so a turn renders as one turn. Defined results: a null turn counts as -1, a null role or text as empty; exactly repeated rows
    count once; rows without conv_id form one conversation; an empty table gives none; other columns are ignored.
    """
    kept = maximal_conversations(conversations).withColumnRenamed("conv_id", "kept_id")
    t = _rows(conversations)
    t = t.join(kept, t["conv_id"].eqNullSafe(F.col("kept_id"))).select("conv_id", "turn", "n_turns", "role", "text").distinct()
    text, role = _plain("text", "role")
    return t.select("conv_id", "turn", "n_turns", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("<|end|>\n")).alias("rendered"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, turn, string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) AS s FROM t GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, sha256(string_agg(turn || chr(3) || s, chr(4)) OVER w) AS h, lead(turn) OVER w IS NULL AS last
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS c FROM p WHERE last AND h NOT IN (SELECT h FROM p WHERE NOT last) GROUP BY h),
n AS (SELECT conv_id, count(*) AS n_turns FROM r GROUP BY conv_id)
SELECT t.conv_id, t.turn, n.n_turns, '<|' || regexp_replace(regexp_replace(t.role, '<(\\*\|)', '<\\\1', 'g'), '\|(\\*>)', '|\\\1', 'g') || '|>' || chr(10)
    || trim(regexp_replace(t.text, '<(\\*\|)', '<\\\1', 'g'), ' ') || '<|end|>' || chr(10) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id JOIN n ON t.conv_id IS NOT DISTINCT FROM n.conv_id
"""
