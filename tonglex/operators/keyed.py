"""A lexicon laid out by key, for lookups beyond the broadcast bound that are made again and again.

Each kind of key is a table in buckets of the key, sorted by it; entries are in buckets of their id, and fingerprints of the
keys that texts are searched for in buckets of the fingerprint. A lookup moves tokens to the buckets: neither index, entries
nor fingerprints pass an exchange (but for fingerprints where the filters are full, see prefixes). The tables lie in the
folder of a store's version and are entered in the session's catalogue when they are opened.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonglex.sources.lexicon import BROADCAST_BYTES, BROADCAST_ROWS, ENTRY, INDEX, KINDS, Lexicon, current_version
from tonglex.sources.staged import create_text, delete_folder, names_in, read_text

from .lookup import chinese_index
from .packed import LONGEST
from .prefixes import Prepared, prepared, with_fingerprints

LAYOUT = "layout"  # a file that names the folder of the tables, and is written when they are whole
BUCKET_BYTES = 64 << 20  # of keys in a bucket, about
_POSTINGS = T.StructType([INDEX["key"], INDEX["pos"], INDEX["word_id"]])
_PRINTS = T.StructType([INDEX["key"], T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])
#: Table: schema, columns of its buckets, order inside.
TABLES = {kind: (_POSTINGS, ["key"], ["key", "pos"]) for kind in (*KINDS, "chinese")}
TABLES |= {f"prints_{kind}": (_PRINTS, ["hi", "lo"], ["hi", "lo"]) for kind in ("english", "chinese")}
TABLES["entries"] = (ENTRY, ["word_id"], ["word_id"])


def lay_out(spark: SparkSession, path: str, version: str | None = None, buckets: int | None = None) -> int:
    """Lay a version of the store (the current one) out by key; returns the number of buckets. Nothing is done where it is laid out
    already. buckets: from the size of the keys, but no fewer than spark.sql.shuffle.partitions, since joins take as many tasks."""
    home = _home(spark, path, version)
    if LAYOUT in names_in(spark, home):
        return json.loads(read_text(spark, f"{home}/{LAYOUT}"))["buckets"]
    plain = Lexicon.read(spark, path, version=home.rsplit("/", 1)[1])
    if buckets is None:
        size = plain.index.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = {kind: plain.part(kind) for kind in KINDS} | {"chinese": chinese_index(plain), "entries": plain.entries}
    rows |= {f"prints_{kind}": with_fingerprints(plain.to_match(kind)) for kind in ("english", "chinese")}
    folder = f"by_key_{uuid.uuid4().hex}"
    for name, df in rows.items():
        _, by, order = TABLES[name]
        # buckets are numbered by the hash that repartition deals by, so each task writes one file
        dealt = df.select(*TABLES[name][0].names).repartition(buckets, *by)
        dealt.write.bucketBy(buckets, *by).sortBy(*order).option("path", f"{home}/{folder}/{name}").saveAsTable(_name(folder, name))
    if not create_text(spark, f"{home}/{LAYOUT}", json.dumps({"folder": folder, "buckets": buckets})):  # another writer was faster
        _forget(spark, folder)
        delete_folder(spark, f"{home}/{folder}")
        return lay_out(spark, path, version)
    return buckets


def _home(spark: SparkSession, path: str, version: str | None) -> str:
    name = version or current_version(spark, path)
    if name is None:
        raise FileNotFoundError(f"no lexicon in {path}")
    return f"{path}/{name}"


def _name(folder: str, table: str) -> str:
    return f"lexicon_{folder}_{table}"


def _forget(spark: SparkSession, folder: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder, name)}")


class KeyedLexicon(Lexicon):
    """A laid-out version of a store. Lookups take it as any lexicon: one of checked size still goes to the tasks."""

    keyed = True

    def __init__(self, spark: SparkSession, home: str, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES):
        if LAYOUT not in names_in(spark, home):
            raise FileNotFoundError(f"{home} is not laid out by key")
        layout = json.loads(read_text(spark, f"{home}/{LAYOUT}"))
        self.spark, self.folder, self.buckets = spark, layout["folder"], layout["buckets"]
        for name, (schema, by, order) in TABLES.items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {_name(self.folder, name)} ({columns}) USING parquet CLUSTERED BY ({', '.join(by)}) "
                f"SORTED BY ({', '.join(order)}) INTO {self.buckets} BUCKETS LOCATION '{home}/{self.folder}/{name}'"
            )
        index = reduce(DataFrame.unionByName, [self.part(kind).withColumn("kind", F.lit(kind)) for kind in KINDS])
        super().__init__(self._table("entries"), index.select(*INDEX.names), broadcast_rows, broadcast_bytes)
        self._prepared: dict[str, Prepared] = {}

    @staticmethod
    def open(spark: SparkSession, path: str, version: str | None = None) -> KeyedLexicon:
        """The current version of a store, or a named one, which lay_out() has laid out."""
        return KeyedLexicon(spark, _home(spark, path, version))

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(_name(self.folder, name))

    def part(self, kind: str) -> DataFrame:
        return self._table(kind)

    @property
    def headwords(self) -> DataFrame:
        return self._table("chinese").select("key").distinct()  # within buckets

    def to_match(self, kind: str) -> Prepared:
        """Fingerprints and filters, made once for all lookups."""
        if kind not in self._prepared:
            self._prepared[kind] = prepared(self._table(f"prints_{kind}"), LONGEST if kind == "english" else 0)
        return self._prepared[kind]

    def release(self) -> None:
        """Also takes the tables out of the catalogue; the files stay."""
        super().release()
        for ready in self._prepared.values():
            ready.ladder.unpersist()
        self._prepared = {}
        _forget(self.spark, self.folder)
