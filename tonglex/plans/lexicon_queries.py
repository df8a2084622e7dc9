"""Segmentation, lookups, conversion and dispatch over Han text made from part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonglex.functions.convert import Scripts
from tonglex.functions.text import normalize
from tonglex.operators.lookup import query, query_by_chinese, query_by_pinyin, query_by_simplified, query_by_traditional, with_entries
from tonglex.operators.segment import Segmenter, tokenize, tokenize_join
from tonglex.sources.lexicon import ENTRY, Lexicon
from tonglex.sql import register

from .text_queries import label_sql, normal_sql, quoted, table

#: Our fixture for the words of part.p_name: English, simplified, traditional, pinyin.
PART_WORDS = (
    ("blue", "蓝", "藍", "lán"), ("cold", "冷", "冷", "lěng"), ("hot", "热", "熱", "rè"), ("large", "大", "大", "dà"),
    ("new", "新", "新", "xīn"), ("old", "旧", "舊", "jiù"), ("red", "红", "紅", "hóng"), ("small", "小", "小", "xiǎo"),
    ("anvil", "铁砧", "鐵砧", "tiě zhēn"), ("bolt", "螺栓", "螺栓", "luó shuān"), ("gear", "齿轮", "齒輪", "chǐ lún"), ("gizmo", "小玩意", "小玩意", "xiǎo wán yì"),
    ("plate", "盘子", "盤子", "pán zi"), ("ring", "戒指", "戒指", "jiè zhi"), ("rod", "杆", "桿", "gǎn"), ("widget", "部件", "部件", "bù jiàn"),
)


def part_lexicon(spark: SparkSession) -> Lexicon:
    from decimal import Decimal

    rows = [(t, s, p, p, [e], [], Decimal(i), [], 1, i) for i, (e, s, t, p) in enumerate(PART_WORDS, 1)]
    rows += [("小", "小", "xiǎo", "xiao3", ["few"], [], Decimal(90), [], 2, 90), ("熱", "热", "rè", "re4", ["heat"], [], Decimal(91), [], 2, 91)]
    return Lexicon.of(spark.createDataFrame(rows, ENTRY))


def part_texts(spark: SparkSession, sf_dir: str, column: int = 1) -> DataFrame:
    """(id, text): every part name in Han, its words without spaces, or of another column of PART_WORDS."""
    words = spark.createDataFrame([(w[0], w[column]) for w in PART_WORDS], "en string, han string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.split("p_name", " ").alias("w"))
    a, b = F.broadcast(words.select(F.col("en").alias("a"), F.col("han").alias("ha"))), F.broadcast(words.select(F.col("en").alias("b"), F.col("han").alias("hb")))
    return p.join(a, F.get("w", F.lit(0)) == a["a"]).join(b, F.get("w", F.lit(1)) == b["b"]).select("id", F.concat("ha", F.lit("，" if column < 3 else " "), "hb", "ha").alias("text"))


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + f") AS t({names}))"


def _han_sql(column: int) -> str:
    v = _values([(quoted(w[0]), quoted(w[column])) for w in PART_WORDS], "en, han")
    return f"(SELECT p_partkey::BIGINT AS id, a.han || '{'，' if column < 3 else ' '}' || b.han || a.han AS text FROM part JOIN {v} a ON a.en = split_part(p_name, ' ', 1) JOIN {v} b ON b.en = split_part(p_name, ' ', 2))"


def _index_sql() -> str:
    rows = [(i, s, t) for i, (_, s, t, _) in enumerate(PART_WORDS, 1)] + [(90, "小", "小"), (91, "热", "熱")]
    out = []
    for kind, at in (("simplified", 1), ("traditional", 2)):
        places: dict[str, int] = {}
        for r in rows:
            out.append((quoted(kind), quoted(r[at]), f"{places.setdefault(r[at], 0)}::BIGINT", f"{r[0]}::BIGINT"))
            places[r[at]] += 1
    return _values(out, "kind, key, pos, word_id")


_KEYS = sorted({w[k] for w in PART_WORDS for k in (1, 2)}, key=lambda k: (-len(k), k))
_PATTERN = "|".join(_KEYS)
_TOKENS = f"SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS tok_pos FROM (SELECT id, regexp_extract_all(text, '{_PATTERN}') AS ts FROM {{}})"
_CHINESE = f"""(SELECT key, row_number() OVER (PARTITION BY key ORDER BY part, pos) - 1 AS pos, word_id FROM (
    SELECT key, 0 AS part, pos, word_id FROM {_index_sql()} WHERE kind = 'simplified'
    UNION ALL SELECT t.key, 1, t.pos, t.word_id FROM {_index_sql()} t ANTI JOIN (SELECT * FROM {_index_sql()} WHERE kind = 'simplified') s ON t.key = s.key AND t.word_id = s.word_id WHERE t.kind = 'traditional'))"""


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def tokenize_han(spark, sf_dir):
    keys = [r["key"] for r in part_lexicon(spark).headwords.collect()]
    return _long(part_texts(spark, sf_dir).select("id", F.posexplode(tokenize(F.col("text"), keys)).alias("tok_pos", "token")))


def tokenize_han_join(spark, sf_dir):
    return _long(tokenize_join(part_texts(spark, sf_dir), "id", "text", part_lexicon(spark).headwords))


def tokenize_latin(spark, sf_dir):
    """Arrow tier over documents: headwords A, ABC-like and a phrase with a space."""
    return _long(table(spark, sf_dir, "documents").select("doc_id", F.posexplode(Segmenter(["th", "thation", "tion", "er the"])(F.col("text"))).alias("tok_pos", "token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.sum("tok_pos").alias("s")))


def lookup_simplified(spark, sf_dir):
    t = part_texts(spark, sf_dir).withColumn("text", F.element_at(F.split("text", "，"), 1))
    return _long(query_by_simplified(t, "id", "text", part_lexicon(spark)))


def lookup_traditional(spark, sf_dir):
    t = part_texts(spark, sf_dir, 2).withColumn("text", F.element_at(F.split("text", "，"), 1))
    return _long(query_by_traditional(t, "id", "text", part_lexicon(spark)))


def lookup_chinese(spark, sf_dir):
    return _long(query_by_chinese(part_texts(spark, sf_dir, 2), "id", "text", part_lexicon(spark)))


def pinyin_lookup(spark, sf_dir):
    return _long(query_by_pinyin(part_texts(spark, sf_dir, 3), "id", "text", part_lexicon(spark)))


def _pinyin_sql() -> str:
    rows = [(w[3], i) for i, w in enumerate(PART_WORDS, 1)] + [("xiǎo", 90), ("rè", 91)]
    marks, plain = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ", "aaaaeeeeiiiioooouuuuüüüü"
    out, seen = [], {}
    for p, i in rows:
        numbers = {90: "xiao3", 91: "re4"}.get(i, p)
        for k in dict.fromkeys(x.replace(" ", "") for x in (p, numbers, p.translate(str.maketrans(marks, plain)))):
            out.append((k, seen.setdefault(k, 0), i))
            seen[k] += 1
    return _values([(quoted(k), f"{n}::BIGINT", f"{i}::BIGINT") for k, n, i in out], "key, pos, word_id")


def to_traditional(spark, sf_dir):
    s = Scripts(part_lexicon(spark).pairs())
    return part_texts(spark, sf_dir).select("id", s.simplified_to_traditional(F.col("text")).alias("converted"))


def to_simplified(spark, sf_dir):
    s = Scripts(part_lexicon(spark).pairs())
    return part_texts(spark, sf_dir, 2).select("id", s.traditional_to_simplified(F.col("text")).alias("converted"))


def script_flags(spark, sf_dir):
    s = Scripts(part_lexicon(spark).pairs())
    return part_texts(spark, sf_dir).select("id", s.is_simplified(F.col("text")).alias("simplified"), s.is_traditional(F.col("text")).alias("traditional"))


def _convert_sql(a: int, b: int, x: str = "text") -> str:
    chars = {x: y for w in PART_WORDS for x, y in zip(w[a], w[b], strict=True) if x != y}
    return f"translate({x}, '{''.join(chars)}', '{''.join(chars.values())}')"


def query_dispatch_join(spark, sf_dir):
    """query_dispatch by the joins that a lexicon beyond the broadcast bound takes."""
    x = part_lexicon(spark)
    x.broadcast_rows = 0
    return query_dispatch(spark, sf_dir, x)


def query_entries(spark, sf_dir):
    """Entries straight from a query."""
    q = query(part_texts(spark, sf_dir), "id", "text", part_lexicon(spark), entries=True)
    return q.select("id", "label", F.array_join(F.transform("hits", lambda h: h["entry"]["traditional"]), ",").alias("traditional"))


def entry_join(spark, sf_dir):
    x = part_lexicon(spark)
    return with_entries(query_by_chinese(part_texts(spark, sf_dir), "id", "text", x), x).select("id", "tok_pos", "idx_pos", "word_id", "entry.traditional", "entry.simplified")


def query_dispatch(spark, sf_dir, lexicon=None):
    """Han, pinyin, English and unclassifiable texts: label, and the hits joined; '-' where there is no list at all."""
    han = part_texts(spark, sf_dir)
    pin = part_texts(spark, sf_dir, 3).withColumn("id", F.col("id") + 1_000_000)
    eng = table(spark, sf_dir, "part").select((F.col("p_partkey").cast("long") + 2_000_000).alias("id"), F.concat("p_name", F.lit(", boat!")).alias("text"))
    none = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") + 3_000_000).alias("id"), F.lit("?!。").alias("text"))
    t = han.unionByName(pin).unionByName(eng).unionByName(none)
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["tok_pos"], h["idx_pos"], h["word_id"])), ",")
    return query(t, "id", "text", lexicon or part_lexicon(spark)).select("id", "label", F.coalesce(hits, F.lit("-")).alias("hits"))


def _sql_names(spark: SparkSession, sf_dir: str, column: int) -> None:
    """SQL names over the part lexicon, and the texts as the view part_texts."""
    register(spark, part_lexicon(spark), "part_")
    part_texts(spark, sf_dir, column).createOrReplaceTempView("part_texts")


def sql_token_rows(spark, sf_dir):
    """Tokens as rows by a lateral view over a SQL name."""
    _sql_names(spark, sf_dir, 1)
    return spark.sql("SELECT id, CAST(tok_pos AS BIGINT) AS tok_pos, token FROM part_texts LATERAL VIEW posexplode(part_tokenize(text)) AS tok_pos, token")


def sql_hit_rows(spark, sf_dir):
    """Hits with their entries as rows: lateral views over SQL names, joined to the view of entries."""
    _sql_names(spark, sf_dir, 1)
    return spark.sql(
        """SELECT id, h.tok_pos, h.idx_pos, h.word_id, e.traditional, e.simplified
        FROM (SELECT id, h FROM (SELECT id, part_query_by_chinese(text) AS hits FROM part_texts) LATERAL VIEW explode(hits) AS h) JOIN part_entries e ON e.word_id = h.word_id"""
    )


def table_token_rows(spark, sf_dir):
    """Tokens as rows by a table function."""
    _sql_names(spark, sf_dir, 1)
    return spark.sql("SELECT id, CAST(tok_pos AS BIGINT) AS tok_pos, token FROM part_token_rows(TABLE(part_texts), 'id', 'text')")


def table_hit_rows(spark, sf_dir):
    """Hits as rows by a table function, joined to the view of entries."""
    _sql_names(spark, sf_dir, 1)
    return spark.sql(
        """SELECT id, CAST(tok_pos AS BIGINT) AS tok_pos, CAST(idx_pos AS BIGINT) AS idx_pos, word_id, traditional, simplified
        FROM part_hit_rows(TABLE(part_texts), 'id', 'text') JOIN part_entries USING (word_id)"""
    )


def table_english_rows(spark, sf_dir):
    """Hits of every document's English words by a table function over a query, counted by entry."""
    register(spark, part_lexicon(spark), "part_")
    table(spark, sf_dir, "documents").createOrReplaceTempView("all_documents")
    return spark.sql(
        """SELECT word_id, count(*) AS n_hits, count(DISTINCT doc_id) AS n_documents
        FROM part_hit_rows(TABLE(SELECT doc_id, concat(lower(part_normalize(text)), ' red bolt') AS given FROM all_documents), 'doc_id', 'given', 'english') GROUP BY word_id"""
    )


def _dispatch_sql(texts: str | None = None) -> str:
    texts = texts or f"""SELECT id, text FROM {_han_sql(1)} UNION ALL SELECT id + 1000000, text FROM {_han_sql(3)}
    UNION ALL SELECT p_partkey::BIGINT + 2000000, p_name || ', boat!' FROM part UNION ALL SELECT r_regionkey::BIGINT + 3000000, '?!。' FROM region"""
    english = _values([(quoted(w[0]), f"{i}::BIGINT") for i, w in enumerate(PART_WORDS, 1)] + [("'few'", "90::BIGINT"), ("'heat'", "91::BIGINT")], "key, word_id")
    return f"""
WITH t AS ({texts}),
n AS (SELECT id, text, n, {label_sql("n")} AS label FROM (SELECT id, text, {normal_sql("text")} AS n FROM t)),
w AS (SELECT id, label, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT id, label, list_filter(string_split(lower(n), ' '), lambda x: x <> '') AS ws FROM n WHERE label IN ('EN', 'PY'))),
h AS (SELECT w.id, p, 0::BIGINT AS pos, word_id FROM w JOIN {english} e ON token = key WHERE label = 'EN'
    UNION ALL SELECT w.id, p, pos, word_id FROM w JOIN {_pinyin_sql()} i ON token = key WHERE label = 'PY'
    UNION ALL SELECT k.id, tok_pos, pos, word_id FROM ({_TOKENS.format("(SELECT id, n AS text FROM n WHERE label = 'ZH')")}) k JOIN {_CHINESE} c ON token = key),
l AS (SELECT id, string_agg(p || ':' || pos || ':' || word_id, ',' ORDER BY p, pos) AS hits FROM h GROUP BY id)
SELECT n.id, label, CASE WHEN label = 'UN' THEN '-' ELSE coalesce(hits, '') END AS hits FROM n LEFT JOIN l ON n.id = l.id"""


def _english_rows_sql() -> str:
    keys = _values([(quoted(w[0]), f"{i}::BIGINT") for i, w in enumerate(PART_WORDS, 1)] + [("'few'", "90::BIGINT"), ("'heat'", "91::BIGINT")], "key, word_id")
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split(lower({normal_sql("text")}) || ' red bolt', ' '), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS p FROM d),
h AS (SELECT doc_id, word_id, lag(word_id) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN {keys} ON token = key)
SELECT word_id, count(*) AS n_hits, count(DISTINCT doc_id) AS n_documents FROM h WHERE before IS NULL OR before <> word_id GROUP BY word_id"""


def norm_of_han(spark, sf_dir):
    return part_texts(spark, sf_dir).select("id", normalize(F.col("text")).alias("norm"))


_FIRST = lambda c: f"(SELECT id, split_part(text, '，', 1) AS text FROM {_han_sql(c)})"
_EXACT = lambda c, kind: f"SELECT id, 0::BIGINT AS tok_pos, pos AS idx_pos, word_id FROM {_FIRST(c)} t JOIN {_index_sql()} i ON i.kind = '{kind}' AND i.key = t.text"
_PART_ENTRIES = _values([(f"{i}::BIGINT", quoted(t), quoted(x)) for i, (_, x, t, _) in enumerate(PART_WORDS, 1)] + [("90::BIGINT", "'小'", "'小'"), ("91::BIGINT", "'熱'", "'热'")], "word_id, traditional, simplified")
_ENTRY_JOIN = f"SELECT id, tok_pos, pos AS idx_pos, word_id, traditional, simplified FROM ({_TOKENS.format(_han_sql(1))}) t JOIN {_CHINESE} c ON t.token = c.key JOIN {_PART_ENTRIES} e USING (word_id)"
LEXICON = {
    "tokenize_han": (tokenize_han, _TOKENS.format(_han_sql(1))),
    "tokenize_han_join": (tokenize_han_join, _TOKENS.format(_han_sql(1))),
    "tokenize_latin": (
        tokenize_latin,
        "SELECT doc_id, token, count(*) AS n, sum(p - 1)::BIGINT AS s FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, 'thation|er the|tion|th') AS ts FROM documents)) GROUP BY 1, 2",
    ),
    "lookup_simplified": (lookup_simplified, _EXACT(1, "simplified")),
    "lookup_traditional": (lookup_traditional, _EXACT(2, "traditional")),
    "lookup_chinese": (lookup_chinese, f"SELECT id, tok_pos, pos AS idx_pos, word_id FROM ({_TOKENS.format(_han_sql(2))}) t JOIN {_CHINESE} c ON t.token = c.key"),
    "pinyin_lookup": (
        pinyin_lookup,
        f"""SELECT id, p AS tok_pos, pos AS idx_pos, word_id FROM (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS p FROM
        (SELECT id, string_split(lower({normal_sql("text", True)}), ' ') AS ws FROM {_han_sql(3)})) t JOIN {_pinyin_sql()} i ON t.token = i.key""",
    ),
    "to_traditional": (to_traditional, f"SELECT id, {_convert_sql(1, 2)} AS converted FROM {_han_sql(1)}"),
    "to_simplified": (to_simplified, f"SELECT id, {_convert_sql(2, 1)} AS converted FROM {_han_sql(2)}"),
    "script_flags": (script_flags, f"SELECT id, {_convert_sql(2, 1)} = text AS simplified, {_convert_sql(1, 2)} = text AS traditional FROM {_han_sql(1)}"),
    "normalize_han": (norm_of_han, f"SELECT id, {normal_sql('text')} AS norm FROM {_han_sql(1)}"),
    "query_dispatch": (query_dispatch, _dispatch_sql()),
    "query_dispatch_join": (query_dispatch_join, _dispatch_sql()),
    "query_entries": (query_entries, f"SELECT id, 'ZH' AS label, string_agg(traditional, ',' ORDER BY tok_pos, idx_pos) AS traditional FROM ({_ENTRY_JOIN}) GROUP BY id"),
    "entry_join": (entry_join, _ENTRY_JOIN),
    "sql_token_rows": (sql_token_rows, _TOKENS.format(_han_sql(1))),
    "sql_hit_rows": (sql_hit_rows, _ENTRY_JOIN),
    "table_token_rows": (table_token_rows, _TOKENS.format(_han_sql(1))),
    "table_hit_rows": (table_hit_rows, _ENTRY_JOIN),
    "table_english_rows": (table_english_rows, _english_rows_sql()),
}
