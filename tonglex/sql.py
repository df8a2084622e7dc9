"""SQL names for the text functions and lexicon tables."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tonglex.functions import syllables, text
from tonglex.functions.convert import Scripts
from tonglex.operators import table_functions
from tonglex.operators.lookup import HITS, packed
from tonglex.operators.segment import tokens_function
from tonglex.sources.lexicon import Lexicon


def register(spark: SparkSession, lexicon: Lexicon, prefix: str = "") -> None:
    """Views entries, index, headwords; functions normalize, normalize_pinyin, classify, query, query_by_english, query_by_pinyin,
    query_by_chinese, tokenize, simplified_to_traditional, traditional_to_simplified, is_simplified, is_traditional; table functions
    token_rows(TABLE(t), 'id', 'text') and hit_rows(TABLE(t), 'id', 'text'[, kind]), with a row for each token or hit.

    For a lexicon of checked size; a larger one raises, and takes the DataFrame functions instead.
    """
    lexicon.views(prefix)
    scripts = Scripts(lexicon.pairs())
    to_t, to_s = scripts.simplified_to_traditional.convert, scripts.traditional_to_simplified.convert
    for name, kind, f in (
        ("simplified_to_traditional", "string", to_t),
        ("traditional_to_simplified", "string", to_s),
        ("is_traditional", "boolean", lambda x: None if x is None else to_t(x) == x),
        ("is_simplified", "boolean", lambda x: None if x is None else to_s(x) == x),
    ):
        spark.udf.register(f"{prefix}{name}", F.pandas_udf(_mapped(f), kind))
    buffer = spark.sparkContext.broadcast(packed(lexicon).value.kinds["chinese"].buffer)
    spark.udf.register(f"{prefix}tokenize", tokens_function(buffer))
    table_functions.register(spark, buffer, packed(lexicon), prefix)
    _register_texts(spark, prefix)
    _register_lookups(spark, lexicon, prefix)


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _function(spark: SparkSession, name: str, kind: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING) RETURNS {kind} RETURN {body}")


def _register_texts(spark: SparkSession, prefix: str) -> None:
    """normalize, normalize_pinyin and classify as SQL expressions, which the optimiser sees through."""
    for name, colon in (("normalize", ":"), ("normalize_pinyin", "(?<![uU]):")):
        gaps = _literal(rf"(?:[\p{{IsWhite_Space}}{text.SEPARATORS}{text.APOSTROPHES}]|{colon})+")
        _function(spark, f"{prefix}{name}", "STRING", f"trim(regexp_replace(regexp_replace(txt, {_literal(text._INNER)}, ''), {gaps}, ' '))")
    plain = f"array_remove(split(translate(lower(txt), '{text.TONED}', '{text.PLAIN}'), ' '), '')"
    kind = syllables.kind_sql("w")
    fits = f"NOT exists({plain}, w -> {kind} = {syllables.NONE} AND NOT rlike(w, '^[1-5]$')) AND (exists({plain}, w -> {kind} = {syllables.PLAIN_WORD}) OR rlike(lower(txt), '[{text.TONED[:-1]}]'))"
    label = (
        "CASE WHEN txt IS NULL THEN NULL WHEN txt = '' THEN 'UN' WHEN rlike(txt, '\\\\p{IsHan}') THEN 'ZH' "
        f"WHEN NOT rlike(txt, '^[1-5](?: |$)') AND {fits} THEN 'PY' WHEN rlike(txt, '\\\\p{{IsAlphabetic}}') THEN 'EN' ELSE 'UN' END"
    )
    _function(spark, f"{prefix}classify_normal", "STRING", label)
    _function(spark, f"{prefix}classify", "STRING", f"{prefix}classify_normal({prefix}normalize(txt))")


def _register_lookups(spark: SparkSession, lexicon: Lexicon, prefix: str) -> None:
    sent = packed(lexicon)

    def finder(kind: str):
        def found(texts: pa.Array) -> pa.Array:
            return sent.value.find(kind, texts).lists(texts.is_null().to_numpy(zero_copy_only=False))

        return found

    for name, given in (("english", f"lower({prefix}normalize(txt))"), ("pinyin", f"lower({prefix}normalize_pinyin(txt))"), ("chinese", "txt")):
        spark.udf.register(f"{prefix}_hits_{name}", F.arrow_udf(_typed(finder(name)), HITS))
        _function(spark, f"{prefix}query_by_{name}", HITS, f"{prefix}_hits_{name}({given})")
    branches = "".join(f" WHEN '{label}' THEN {prefix}query_by_{name}({given})" for label, name, given in (("EN", "english", "txt"), ("PY", "pinyin", "txt"), ("ZH", "chinese", f"{prefix}normalize(txt)")))
    _function(spark, f"{prefix}query", HITS, f"CASE {prefix}classify(txt){branches} END")


def _mapped(f):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


def _typed(f):
    """f with the hints that an Arrow function is told by."""

    def run(texts: pa.Array) -> pa.Array:
        return f(texts)

    return run
