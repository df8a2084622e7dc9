"""Quality rules: a threshold table compiled into one projection of built-in expressions.

No user function runs: words, lines and windows are arrays, and everything about a
document is worked out in its own row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 5
#: Frequent function words of the corpus languages (en, de, es, fr), lower case.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which had "
    "der die das und in zu den von ist mit im auf für des sich dem ein eine als auch nicht es "
    "de la que el en y los se del las un por con una su para es al lo como más "
    "le les des et à un une du dans est pour qui au sur par avec ce il ne pas on"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: `metric` must lie within [low, high] (None: open), for texts of `from_words` words or more."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Ratios are over words or lines; a metric without a denominator is 0.
RULES = (
    Rule("length", "mean_word_chars", 1.5, 25.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.01, None, from_words=50),
    Rule("lines", "dup_line_ratio", None, 0.5),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row breaks, in the table's order."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        bad = bad & (F.col("n_words") >= r.from_words)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: row (the input row), doc_id, the measures, base_failed, kept, broken_rules.

    Defined results: a null or empty text has no words, so base_failed is true and kept false;
    null doc_ids and repeated rows stay as they are; other columns are only carried along, inside row.
    n_repeat_words compares five-word windows by a 64-bit hash of five 64-bit word hashes.
    """
    spaces = "\t\n\x0b\f\r"
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select(
        "row", "doc_id",
        F.array_remove(F.split(F.translate("t", spaces, " " * len(spaces)), " "), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0).alias("lines"),
        F.length(F.translate("t", " " + spaces, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "row", "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop"]
    window = lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, WINDOW)))
    d = d.select(*kept, F.when(F.size("h") >= WINDOW, F.transform(F.slice("h", 1, F.size("h") - (WINDOW - 1)), window)).alias("g"))
    d = d.select(*kept, F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = lambda e, k: F.coalesce(e["x"] == F.get("s", k - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get("s", k + 1)["x"], F.lit(False))
    d = d.select(*kept, F.sort_array(F.transform(F.filter("s", same), lambda e: e["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    d = d.withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "n_words"),
            "stop_ratio": _ratio("n_stop", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    d = d.withColumn("broken_rules", verdict(rules))
    # the row number makes this projection one that filters stay above of: moved below, they would work out the arrays anew for every word
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0) & (F.monotonically_increasing_id() >= 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass every rule, with all their columns."""
    return with_quality(docs, rules).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = with_quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))


def _sql() -> str:
    bad = []
    for r in RULES:
        limits = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        bad.append(f"CASE WHEN ({' OR '.join(limits)}) AND n_words >= {r.from_words} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
    FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT pos + k) AS n FROM r, range({WINDOW}) AS x(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov ON w.rid = cov.rid),
q AS (SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbol_ratio, {ratio("n_stop", "n_words")} AS stop_ratio,
    {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (SELECT *, list_filter([{", ".join(bad)}], lambda x: x IS NOT NULL) AS broken FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules FROM v
"""


ORACLE_SQL = _sql()
