"""Normalisation and classification of query text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import syllables

#: Apostrophes, and the characters that separate words of a query (a colon is treated by mode).
APOSTROPHES = "'‘’"
SEPARATORS = (
    r"!\"(),\-./;?\[\\\]`{}"
    "¡¿‐-―‘-‟…、。〈-】〔-〟"
    "︐-︖︵-﹄﹐-﹒﹔-﹗﹙-﹞"
    "！＂＇（），－．／：；？［＼］｀｛｝"
)
_INNER = rf"(?<=[\p{{IsAlphabetic}}\p{{N}}])[{APOSTROPHES}](?=[\p{{IsAlphabetic}}\p{{N}}])"

TONED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü"
PLAIN = "aaaaeeeeiiiioooouuuuvvvvv"

LABELS = ("EN", "PY", "ZH", "UN")


def normalize(text: Column, pinyin: bool = False) -> Column:
    """Separators and white space collapse to single spaces; apostrophes inside words vanish; no case folding.

    With `pinyin`, a colon after u or U belongs to the word. NULL gives NULL.
    """
    colon = "(?<![uU]):" if pinyin else ":"
    joined = F.regexp_replace(text, _INNER, "")
    return F.trim(F.regexp_replace(joined, rf"(?:[\p{{IsWhite_Space}}{SEPARATORS}{APOSTROPHES}]|{colon})+", " "))


def words(normal: Column) -> Column:
    """Words of normalised text; none for an empty one."""
    return F.array_remove(F.split(normal, " "), "")


def fold_tones(text: Column) -> Column:
    return F.translate(F.lower(text), TONED, PLAIN)


def pinyin_kind(word: Column) -> Column:
    """Kind of a folded word: 0 no pinyin, 1 pinyin, 2 pinyin only beside other pinyin, because it ends in an r without a tone."""
    rows, kinds, start = syllables.table()
    states, letters = F.array(*map(F.lit, rows)), F.lit(syllables.LETTERS)
    step = lambda s, c: F.ascii(F.substr(F.get(states, s), F.position(c, letters) + 1, F.lit(1))) - syllables._FIRST
    return F.get(F.array(*map(F.lit, kinds)), F.aggregate(F.split(word, ""), F.lit(start), step))


def is_pinyin(normal: Column) -> Column:
    """Every word is pinyin; later words may be a tone number alone. A syllable with an r and no tone needs a plain word beside it, or a tone mark."""
    folded = words(fold_tones(normal))
    # exists() stops at the first word that does not fit
    fits = ~normal.rlike("^[1-5](?: |$)") & ~F.exists(folded, lambda w: (pinyin_kind(w) == syllables.NONE) & ~w.rlike("^[1-5]$"))
    return fits & (F.exists(folded, lambda w: pinyin_kind(w) == syllables.PLAIN_WORD) | F.lower(normal).rlike(f"[{TONED[:-1]}]"))


def classify_normal(normal: Column) -> Column:
    """EN, PY, ZH or UN for normalised text; NULL for NULL."""

    def label(n: Column) -> Column:
        return (
            F.when(n.isNull(), F.lit(None).cast("string"))
            .when(n == "", "UN")
            .when(n.rlike(r"\p{IsHan}"), "ZH")
            .when(is_pinyin(n), "PY")
            .when(n.rlike(r"\p{IsAlphabetic}"), "EN")
            .otherwise("UN")
        )

    return F.get(F.transform(F.array(normal), label), F.lit(0))  # the text is normalised once, not once a branch


def classify(text: Column) -> Column:
    return classify_normal(normalize(text))
