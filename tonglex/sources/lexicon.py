"""The lexicon: entries, ordered inverted index and headwords; loading, checks and sinks."""

from __future__ import annotations

import re
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staged import create_text, names_in, read_text

_s = lambda name: T.StructField(name, T.StringType(), False)
MEASURE_WORD = T.StructType([_s("traditional"), _s("simplified"), _s("pinyin_marks"), _s("pinyin_numbers")])
ENTRY = T.StructType(
    [
        _s("traditional"), _s("simplified"), _s("pinyin_marks"), _s("pinyin_numbers"),
        T.StructField("english", T.ArrayType(T.StringType(), False), False),
        T.StructField("tone_marks", T.ArrayType(T.ShortType(), False), False),
        T.StructField("hash", T.DecimalType(20, 0), False),
        T.StructField("measure_words", T.ArrayType(MEASURE_WORD, False), False),
        T.StructField("hsk", T.ShortType(), False),
        T.StructField("word_id", T.LongType(), False),
    ]
)
INDEX = T.StructType([_s("kind"), _s("key"), T.StructField("pos", T.IntegerType(), False), T.StructField("word_id", T.LongType(), False)])
KINDS = ("traditional", "simplified", "pinyin", "english")
#: An index goes to every task if it has so many rows and bytes of keys at most; beyond that, lookups are joins.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


MANIFEST = "current-"  # a numbered file for each version that became current


def manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix(MANIFEST)) for n in names_in(spark, path) if re.fullmatch(rf"{MANIFEST}\d+", n))


def current_version(spark: SparkSession, path: str) -> str | None:
    found = manifests(spark, path)
    return read_text(spark, f"{path}/{MANIFEST}{found[-1]:09d}") if found else None


class Lexicon:
    keyed = False  # whether the tables are laid out by key (operators.keyed)

    def __init__(self, entries: DataFrame, index: DataFrame, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES):
        self.entries, self.index, self.broadcast_rows, self.broadcast_bytes = entries, index, broadcast_rows, broadcast_bytes
        self.sent: Broadcast | None = None  # keys and entries that tasks have
        self.entries_sent: Broadcast | None = None
        self._small: bool | None = None

    @property
    def headwords(self) -> DataFrame:
        return self.index.where(F.col("kind").isin("simplified", "traditional")).select("key").distinct()

    def part(self, kind: str) -> DataFrame:
        """(key, pos, word_id) of a kind of keys."""
        return self.index.where(F.col("kind") == kind).select("key", "pos", "word_id")

    def to_match(self, kind: str) -> DataFrame:
        """The keys that texts are searched for: of English, or headwords."""
        return self.part("english") if kind == "english" else self.headwords

    @staticmethod
    def read(spark: SparkSession, path: str, check: bool = True, version: str | None = None) -> Lexicon:
        """The current version of a store, or a named one. Explicit schemas; check() raises on a damaged lexicon."""
        name = version or current_version(spark, path)
        if name is None:
            raise FileNotFoundError(f"no lexicon in {path}")
        out = Lexicon(spark.read.schema(ENTRY).parquet(f"{path}/{name}/entries"), spark.read.schema(INDEX).parquet(f"{path}/{name}/index").select(*INDEX.names))
        if check:
            out.check()
        return out

    def write(self, path: str) -> str:
        """A new version beside the others, which becomes the current one when both its tables are there; readers of earlier versions
        are not disturbed. Returns its name."""
        spark = self.entries.sparkSession
        name = f"v-{uuid.uuid4().hex}"
        self.entries.write.parquet(f"{path}/{name}/entries")
        self.index.write.partitionBy("kind").parquet(f"{path}/{name}/index")  # by the tasks that made it: a kind may be of any size
        number = max(manifests(spark, path), default=0) + 1
        while not create_text(spark, f"{path}/{MANIFEST}{number:09d}", name):  # another writer was faster
            number += 1
        return name

    @staticmethod
    def of(entries: DataFrame, ranked: bool = True) -> Lexicon:
        """Derive the index: headwords as they are, pinyin in three spellings, glosses as words and runs of up to four words."""
        pin = F.array_distinct(
            F.transform(
                F.array("pinyin_marks", "pinyin_numbers", F.translate(F.translate(F.lower("pinyin_marks"), "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ", "aaaaeeeeiiiioooouuuuüüüü"), "12345", "")),
                lambda x: F.regexp_replace(F.lower(x), "[ '’]", ""),
            )
        )
        gloss = F.transform("english", lambda g: F.lower(F.trim(F.regexp_replace(g, r"\(.*?\)|[,.;!?]", ""))))
        gloss = F.filter(gloss, lambda g: (g != "") & (F.size(F.split(g, " ")) <= 4))
        english = F.array_distinct(F.concat(F.transform(gloss, lambda g: F.regexp_replace(g, " +", "%20")), F.filter(F.transform(gloss, lambda g: F.regexp_extract(g, "^to ([^ ]+)$", 1)), lambda g: g != "")))
        keys = {"traditional": F.array("traditional"), "simplified": F.array("simplified"), "pinyin": pin, "english": english}
        # one pass over the entries for all kinds
        of_kind = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
        found = F.concat(*(F.coalesce(F.transform(c, of_kind(kind)), F.array().cast("array<struct<kind:string,key:string>>")) for kind, c in keys.items()))
        union = entries.select(F.explode(found).alias("k"), "hsk", "word_id").select("k.kind", "k.key", "hsk", "word_id")
        order = Window.partitionBy("kind", "key").orderBy(*(["hsk"] if ranked else []), "word_id")
        return Lexicon(entries, union.select("kind", "key", (F.row_number().over(order) - 1).alias("pos"), "word_id"))

    def warm(self) -> Lexicon:
        """Cache both tables now instead of on first use."""
        self.entries, self.index = self.entries.cache(), self.index.cache()
        self.entries.count()
        self.index.count()
        return self

    def check(self) -> None:
        """Raise if ids repeat, an index id is dangling, or places within a key do not run from 0 on."""
        twice = self.entries.groupBy("word_id").count().where("count > 1")
        dangling = self.index.join(self.entries, "word_id", "left_anti")
        gaps = self.index.groupBy("kind", "key").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("d")).where("n <> last + 1 or d <> n")
        for what, df in (("repeated word_id", twice), ("dangling word_id", dangling), ("gap in pos", gaps)):
            if bad := df.take(3):
                raise ValueError(f"lexicon: {what}: {bad}")

    def small(self) -> bool:
        """Whether the index is within broadcast_rows and broadcast_bytes; measured once."""
        if self._small is None:
            n, size = self.index.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
            self._small = n <= self.broadcast_rows and size <= self.broadcast_bytes
        return self._small

    def release(self) -> None:
        """Give back what warm() cached and what tasks were sent."""
        self.entries.unpersist()
        self.index.unpersist()
        for sent in (self.sent, self.entries_sent):
            if sent is not None:
                sent.unpersist()
        self.sent = self.entries_sent = None

    def pairs(self) -> list[tuple[str, str]]:
        """(traditional, simplified) by rank."""
        if not self.small():
            raise ValueError(f"the index has over {self.broadcast_rows} rows or {self.broadcast_bytes} bytes of keys")
        return [(r[0], r[1]) for r in self.entries.orderBy("hsk", "word_id").select("traditional", "simplified").collect()]

    def views(self, prefix: str = "") -> None:
        self.entries.createOrReplaceTempView(f"{prefix}entries")
        self.index.createOrReplaceTempView(f"{prefix}index")
        self.headwords.createOrReplaceTempView(f"{prefix}headwords")


#: Our own fixture: traditional, simplified, marks, numbers, glosses, measure word or None, level.
SEED = (
    ("西瓜", "西瓜", "xī guā", "xi1 gua1", ("watermelon",), ("條", "条", "tiáo", "tiao2"), 2),
    ("執行", "执行", "zhí xíng", "zhi2 xing2", ("to run", "to carry out"), None, 5),
    ("人們", "人们", "rén men", "ren2 men5", ("people",), None, 4),
    ("繁體字", "繁体字", "fán tǐ zì", "fan2 ti3 zi4", ("traditional Chinese character",), None, 7),
    ("簡體字", "简体字", "jiǎn tǐ zì", "jian3 ti3 zi4", ("simplified Chinese character",), None, 7),
    ("龍紋", "龙纹", "lóng wén", "long2 wen2", ("dragon (as a decorative design)",), None, 7),
    ("你好", "你好", "nǐ hǎo", "ni3 hao3", ("hello", "hi"), None, 1),
    ("你", "你", "nǐ", "ni3", ("you",), None, 1),
    ("好", "好", "hǎo", "hao3", ("good",), None, 1),
    ("寒冷", "寒冷", "hán lěng", "han2 leng3", ("cold",), None, 4),
    ("電腦", "电脑", "diàn nǎo", "dian4 nao3", ("computer",), ("臺", "台", "tái", "tai2"), 1),
    ("北京", "北京", "Běi jīng", "Bei3 jing1", ("Beijing",), None, 1),
    ("西安", "西安", "Xī'ān", "Xi1'an1", ("Xi'an",), None, 3),
    ("以後", "以后", "yǐ hòu", "yi3 hou4", ("after", "later"), None, 2),
    ("用於", "用于", "yòng yú", "yong4 yu2", ("to use for",), None, 5),
    ("捨不得", "舍不得", "shě bu5 de5", "she3 bu5 de5", ("to hate to part with",), None, 5),
    ("萬", "万", "wàn", "wan4", ("ten thousand",), None, 3),
    ("万", "万", "mò", "mo4", ("surname Mo",), None, 7),
    ("萬", "万", "Wàn", "Wan4", ("surname Wan",), None, 7),
    ("今天", "今天", "jīn tiān", "jin1 tian1", ("today",), None, 1),
    ("的", "的", "de", "de5", ("of",), None, 1),
    ("天氣", "天气", "tiān qì", "tian1 qi4", ("weather",), None, 1),
    ("挺", "挺", "tǐng", "ting3", ("quite",), None, 4),
    ("爽", "爽", "shuǎng", "shuang3", ("pleasant",), None, 6),
    ("紅色", "红色", "hóng sè", "hong2 se4", ("red",), None, 2),
    ("是", "是", "shì", "shi4", ("to be",), None, 1),
    ("我", "我", "wǒ", "wo3", ("I",), None, 1),
    ("顏色", "颜色", "yán sè", "yan2 se4", ("color",), ("個", "个", "gè", "ge4"), 2),
    ("不錯", "不错", "bù cuò", "bu4 cuo4", ("not bad",), None, 2),
    ("綠", "绿", "lǜ", "lu:4", ("green",), None, 3),
    ("還", "还", "hái", "hai2", ("still",), None, 2),
    ("社區", "社区", "shè qū", "she4 qu1", ("community",), None, 5),
    ("世界", "世界", "shì jiè", "shi4 jie4", ("world",), None, 3),
    ("測試", "测试", "cè shì", "ce4 shi4", ("test",), None, 4),
)


def seed_rows() -> list[tuple]:
    from decimal import Decimal

    return [
        (t, s, m, n, list(e), [int(d) for d in re.findall(r"\d", n)], Decimal(i * 2654435761 % 2**64), [w] if w else [], h, i)
        for i, (t, s, m, n, e, w, h) in enumerate(SEED, 1)
    ]


def seed(spark: SparkSession) -> Lexicon:
    return Lexicon.of(spark.createDataFrame(seed_rows(), ENTRY))
