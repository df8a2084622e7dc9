"""Lexicons and texts that grow with `part`: an entry of every part, round trips, integrity, headwords, and names behind every kind of separator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonglex.functions.text import normalize
from tonglex.operators.keyed import KeyedLexicon, lay_out
from tonglex.operators.lookup import chinese_index, query, query_by_chinese
from tonglex.operators.rewrite import converted
from tonglex.sources import dictionary
from tonglex.sources.lexicon import ENTRY, Lexicon
from tonglex.sources.staged import delete_later, shared_folder

from .lexicon_queries import PART_WORDS, _convert_sql, _dispatch_sql, _han_sql, _values, part_lexicon, part_texts
from .text_queries import normal_sql, quoted, table

DIGITS = "〇一二三四五六七八九"
#: What stands between the words of a name, by p_partkey.
BETWEEN = (" ", ",", "、、", "。", "’", "'", " + ", "「", ":", "\t", "，\n", "...", "/", " ~ ", "·", "？！ ", "''", "_", "u:", "%20")


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry of every part whose words are known: its name in Han and its number in Han digits, so that headwords differ."""
    words = spark.createDataFrame(PART_WORDS, "en string, simplified string, traditional string, pinyin string")
    a, b = (F.broadcast(words.select(*(F.col(c).alias(f"{c}_{k}") for c in words.columns))) for k in ("a", "b"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name", F.split("p_name", " ").alias("w"), F.col("p_size").cast("int").alias("size"))
    p = p.join(a, F.get("w", F.lit(0)) == F.col("en_a")).join(b, F.get("w", F.lit(1)) == F.col("en_b"))
    han = lambda c: F.concat(f"{c}_a", f"{c}_b", F.translate(F.col("k").cast("string"), "0123456789", DIGITS))
    marks = F.concat_ws(" ", "pinyin_a", "pinyin_b")
    measure = F.struct(F.lit("個").alias("traditional"), F.lit("个").alias("simplified"), F.lit("gè").alias("pinyin_marks"), F.lit("ge4").alias("pinyin_numbers"))
    none = F.array().cast(ENTRY["measure_words"].dataType.simpleString())
    columns = {
        "traditional": han("traditional"), "simplified": han("simplified"), "pinyin_marks": marks, "pinyin_numbers": marks, "english": F.array("p_name", F.concat(F.lit("part "), F.col("k").cast("string"))),
        "tone_marks": F.array(), "hash": F.col("k"), "measure_words": F.when(F.col("size") % 2 == 0, F.array(measure)).otherwise(none), "hsk": F.lit(1), "word_id": F.col("k"),
    }
    return p.select(*(c.cast(ENTRY[name].dataType.simpleString()).alias(name) for name, c in columns.items()))


def grown_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return Lexicon.of(part_entries(spark, sf_dir))


def lexicon_round_trip(spark, sf_dir):
    """Entries written as Parquet, read with the explicit schema, checked and warmed."""
    path = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}"
    grown_lexicon(spark, sf_dir).write(path)
    delete_later(spark, path)
    return Lexicon.read(spark, path).warm().entries.select("word_id", "traditional", "simplified", F.size("english").cast("long").alias("n_english"))


def measure_words_explode(spark, sf_dir):
    e = part_entries(spark, sf_dir)
    return e.select("word_id", F.explode("measure_words").alias("m")).select("word_id", "m.*")


def entries_json(spark, sf_dir):
    """A round trip through JSON keeps every entry."""
    e = part_entries(spark, sf_dir)
    back = e.select("word_id", F.from_json(F.to_json(F.struct(*e.columns)), ENTRY).alias("b"))
    return back.select("word_id", "b.traditional", "b.simplified", F.size("b.english").cast("long").alias("n_english"))


def index_integrity(spark, sf_dir):
    x = grown_lexicon(spark, sf_dir)
    x.check()
    return x.index.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("n_ids"), F.countDistinct("key").alias("n_keys"))


def headword_union(spark, sf_dir):
    return grown_lexicon(spark, sf_dir).headwords


def self_segmentation(spark, sf_dir):
    """Every headword segments to itself and finds its own entries."""
    x = grown_lexicon(spark, sf_dir)
    got = query_by_chinese(x.headwords.withColumn("id", F.col("key")), "id", "key", x).groupBy("id").agg(F.count("*").alias("n"), F.max("tok_pos").alias("last"))
    want = chinese_index(x).groupBy("key").agg(F.count("*").alias("want"))
    j = x.headwords.join(want, "key").join(got, F.col("key") == F.col("id"), "left")
    return j.select("key", (F.coalesce("n", F.lit(0)) == F.col("want")).alias("same"), (F.col("last") == 0).alias("one_token"))


def keyed_lookup(spark, sf_dir):
    """Names and numbers of all parts, in Han and in English, looked up with their entries in a lexicon of all parts laid out by key."""
    path = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}"
    e = part_entries(spark, sf_dir)
    Lexicon.of(e).write(path)
    delete_later(spark, path)
    lay_out(spark, path)
    x = KeyedLexicon.open(spark, path)
    x.broadcast_rows = 0  # as if it were larger than what tasks are sent
    han = e.select(F.col("word_id").alias("id"), F.concat("simplified", F.lit("、"), "traditional").alias("text"))
    english = e.select((F.col("word_id") + 1_000_000_000).alias("id"), F.concat(F.lit("See part "), F.col("word_id").cast("string"), F.lit(", please.")).alias("text"))
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["tok_pos"], h["idx_pos"], h["word_id"], h["entry"]["traditional"])), ",")
    return query(han.unionByName(english), "id", "text", x, entries=True).select("id", "label", hits.alias("hits"))


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): words of part names with a separator of BETWEEN inside and around."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.split("p_name", " ").alias("w"))
    sep = F.element_at(F.array(*map(F.lit, BETWEEN)), (F.col("id") % len(BETWEEN) + 1).cast("int"))
    return p.select("id", F.concat(sep, F.get("w", F.lit(0)), sep, F.get("w", F.lit(1)), sep, F.get("w", F.lit(0))).alias("text"))


def normalize_edge_cases(spark, sf_dir):
    return separated(spark, sf_dir).select("id", normalize(F.col("text")).alias("general"), normalize(F.col("text"), pinyin=True).alias("pinyin"))


def query_edge_cases(spark, sf_dir):
    """Labels and hits of names behind separators: those of the plain words, wherever the separator divides."""
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["tok_pos"], h["idx_pos"], h["word_id"])), ",")
    return query(separated(spark, sf_dir), "id", "text", part_lexicon(spark)).select("id", "label", F.coalesce(hits, F.lit("-")).alias("hits"))


def dictionary_lines(spark, sf_dir):
    """Entries of parts as dictionary text, read back by the data source in small splits; lines without brackets come back as damaged."""
    e = part_entries(spark, sf_dir)
    line = F.concat_ws(" ", "traditional", "simplified", F.when(F.col("word_id") % 7 != 0, F.concat(F.lit("[bu4 jian4 "), "word_id", F.lit("]"))).otherwise(F.col("word_id").cast("string")), F.concat(F.lit("/"), F.array_join("english", "/"), F.lit("/")))
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    e.select(F.explode(F.array(F.concat(F.lit("# "), "word_id"), line)).alias("value")).write.text(path)
    delete_later(spark, path)
    dictionary.register(spark)
    d = spark.read.format("dictionary_text").option("split_bytes", 4096).load(path)
    return d.select("traditional", "simplified", "pinyin_numbers", F.size("english").cast("long").alias("n_english"), "damaged")


#: Phrases whose characters do not correspond: simplified, traditional.
IRREGULAR = (("螺栓大", "巨釘"), ("戒指蓝", "寶藍指環"), ("小玩意新", "新奇小玩意"))


def phrase_lexicon(spark: SparkSession) -> Lexicon:
    from decimal import Decimal

    rows = [(t, s, "x", "x", ["x"], [], Decimal(k), [], 9, k) for k, (s, t) in enumerate(IRREGULAR, 200)]
    x = Lexicon.of(part_lexicon(spark).entries.unionByName(spark.createDataFrame(rows, ENTRY)))
    x.broadcast_rows = 0  # as if it were larger than what tasks are sent
    return x


def to_traditional_join(spark, sf_dir):
    """Conversion by joins, with irregular phrases; same: texts that are traditional already."""
    both = part_texts(spark, sf_dir).unionByName(part_texts(spark, sf_dir, 2).withColumn("id", F.col("id") + 1_000_000))
    return converted(both, "id", "text", phrase_lexicon(spark), "traditional").select("id", "converted", "same")


def to_simplified_join(spark, sf_dir):
    return converted(part_texts(spark, sf_dir, 2), "id", "text", phrase_lexicon(spark), "simplified").select("id", "converted", "same")


_BOTH = f"(SELECT id, text FROM {_han_sql(1)} UNION ALL SELECT id + 1000000, text FROM {_han_sql(2)})"


def _phrases_sql(a: int, b: int) -> str:
    """Irregular phrases by marks of their own, so that what they become is not converted again."""
    x = "text"
    for k, pair in enumerate(IRREGULAR):
        x = f"replace({x}, '{pair[a - 1]}', '{k}')"
    x = _convert_sql(a, b, x)
    for k, pair in enumerate(IRREGULAR):
        x = f"replace({x}, '{k}', '{pair[b - 1]}')"
    return x


_SEPARATED = f"""(SELECT p_partkey::BIGINT AS id, s || split_part(p_name, ' ', 1) || s || split_part(p_name, ' ', 2) || s || split_part(p_name, ' ', 1) AS text
    FROM (SELECT p_partkey, p_name, [{', '.join(quoted(x) for x in BETWEEN)}][1 + p_partkey % {len(BETWEEN)}] AS s FROM part))"""


def _entries_sql() -> str:
    v = _values([tuple(map(quoted, w)) for w in PART_WORDS], "en, s, t, p")
    number = f"translate(p_partkey::VARCHAR, '0123456789', '{DIGITS}')"
    return f"""(SELECT p_partkey::BIGINT AS word_id, a.t || b.t || {number} AS traditional, a.s || b.s || {number} AS simplified, a.p || ' ' || b.p AS marks, p_name, p_size
        FROM part JOIN {v} a ON a.en = split_part(p_name, ' ', 1) JOIN {v} b ON b.en = split_part(p_name, ' ', 2))"""


_E = _entries_sql()
_HEADS = f"SELECT DISTINCT key FROM (SELECT traditional AS key FROM {_E} UNION ALL SELECT simplified FROM {_E})"
_PLAIN = "translate(replace(lower(marks), ' ', ''), 'āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ', 'aaaaeeeeiiiioooouuuuüüüü')"
_INDEX = f"""SELECT 'traditional' AS kind, traditional AS key, word_id FROM {_E} UNION ALL SELECT 'simplified', simplified, word_id FROM {_E}
    UNION ALL SELECT DISTINCT 'pinyin', unnest([replace(lower(marks), ' ', ''), {_PLAIN}]), word_id FROM {_E}
    UNION ALL SELECT 'english', unnest([replace(p_name, ' ', '%20'), 'part%20' || word_id]), word_id FROM {_E}"""
PART = {
    "lexicon_round_trip": (lexicon_round_trip, f"SELECT word_id, traditional, simplified, 2::BIGINT AS n_english FROM {_E}"),
    "measure_words_explode": (measure_words_explode, f"SELECT word_id, '個' AS traditional, '个' AS simplified, 'gè' AS pinyin_marks, 'ge4' AS pinyin_numbers FROM {_E} WHERE p_size % 2 = 0"),
    "entries_json": (entries_json, f"SELECT word_id, traditional, simplified, 2::BIGINT AS n_english FROM {_E}"),
    "index_integrity": (index_integrity, f"SELECT kind, count(*) AS n, count(DISTINCT word_id) AS n_ids, count(DISTINCT key) AS n_keys FROM ({_INDEX}) GROUP BY kind"),
    "headword_union": (headword_union, _HEADS),
    "self_segmentation": (self_segmentation, f"SELECT key, true AS same, true AS one_token FROM ({_HEADS})"),
    "keyed_lookup": (
        keyed_lookup,
        f"""SELECT word_id AS id, 'ZH' AS label, '0:0:' || word_id || ':' || traditional || ',1:0:' || word_id || ':' || traditional AS hits FROM {_E}
        UNION ALL SELECT word_id + 1000000000, 'EN', '1:0:' || word_id || ':' || traditional FROM {_E}""",
    ),
    "normalize_edge_cases": (normalize_edge_cases, f"SELECT id, {normal_sql('text')} AS general, {normal_sql('text', True)} AS pinyin FROM {_SEPARATED}"),
    "dictionary_lines": (
        dictionary_lines,
        f"""SELECT CASE WHEN ok THEN traditional END AS traditional, CASE WHEN ok THEN simplified END AS simplified, CASE WHEN ok THEN 'bu4 jian4 ' || word_id END AS pinyin_numbers,
        CASE WHEN ok THEN 2::BIGINT END AS n_english, CASE WHEN NOT ok THEN concat_ws(' ', traditional, simplified, word_id, '/' || p_name || '/part ' || word_id || '/') END AS damaged FROM (SELECT *, word_id % 7 <> 0 AS ok FROM {_E})""",
    ),
    "to_traditional_join": (to_traditional_join, f"SELECT id, {_phrases_sql(1, 2)} AS converted, {_phrases_sql(1, 2)} = text AS same FROM {_BOTH}"),
    "to_simplified_join": (to_simplified_join, f"SELECT id, {_phrases_sql(2, 1)} AS converted, {_phrases_sql(2, 1)} = text AS same FROM {_han_sql(2)}"),
    "query_edge_cases": (query_edge_cases, _dispatch_sql(f"SELECT id, text FROM {_SEPARATED}")),
}
