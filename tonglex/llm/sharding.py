"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of places. A row's place comes from a hash of its id and content;
the shard of the next virtual node clockwise takes it. Under the law `rows` every shard has a
capacity, N // n or one more, and rows that find it full go on clockwise, so counts differ by
one at most. Only the number of rows at each place reaches the driver: 65,536 numbers however
large the table. Under the law `key` there are no bounds, and a new shard only takes rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, stage_table, table

PLACES = 1 << 16
VIRTUAL_NODES = 256
SHARDS = 40


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise. A place wanted twice belongs to the lower shard number."""
    nodes: dict[int, int] = {}
    for s in range(n_shards):
        for v in range(virtual_nodes):
            place = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % PLACES
            nodes[place] = min(s, nodes.get(place, s))
    return sorted(nodes.items())


def owners(n_shards: int) -> list[int]:
    """The shard that each place of the ring belongs to."""
    nodes = ring(n_shards)
    places = [p for p, _ in nodes]
    return [nodes[bisect_left(places, i) % len(nodes)][1] for i in range(PLACES)]


def bounded_loads(counts: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) for rows put in clockwise from place 0.

    Rows that find a shard full take the next virtual node whose shard has room.
    """
    nodes = ring(n_shards)
    places = [p for p, _ in nodes]
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    onward = list(range(len(nodes)))  # the next node with room, with paths shortened as they are walked

    def with_room(k: int) -> int:
        path = []
        while not room[nodes[k][1]]:
            path.append(k)
            k = onward[k] if onward[k] != k else (k + 1) % len(nodes)
        for p in path:
            onward[p] = k
        return k

    out = []
    for place, count in enumerate(counts):
        done = 0
        k = bisect_left(places, place) % len(nodes)
        while done < count:
            k = with_room(k)
            s = nodes[k][1]
            n = min(room[s], count - done)
            out.append((place, done, done + n, s, used[s]))
            room[s] -= n
            used[s] += n
            done += n
    return out


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard for every input row.

    Defined results: a null text counts as empty (size 16); null doc_ids and repeated rows each take a
    place of their own, ties between equal rows being interchangeable; an empty table gives none.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"law must be rows or key, not {law!r}")
    spark = docs.sparkSession
    d = docs_of(docs).select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    h = F.xxhash64("doc_id") if law == "key" else F.xxhash64("doc_id", "text_crc32", "size")
    d = stage_table(d.withColumn("h", h), "shard").withColumn("place", F.pmod(F.col("h"), F.lit(PLACES)).cast("int"))
    if law == "key":
        now, grown = owners(n_shards), owners(n_shards + 1)
        where = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(now, grown, strict=True))], "place int, shard int, grown_shard int")
        d = d.join(F.broadcast(where), "place")
        # a slot is the rank in the shard: places in order, rows in order within a place
        per = d.groupBy("place", "shard").count()
        first = per.select("place", (F.sum("count").over(Window.partitionBy("shard").orderBy("place")) - F.col("count")).alias("first"))
        d = d.join(F.broadcast(first), "place")
        d = d.withColumn("slot", F.col("first") + F.row_number().over(Window.partitionBy("place").orderBy("h", "doc_id", "text_crc32")) - 1)
    else:
        counts = [0] * PLACES
        for r in d.groupBy("place").count().toLocalIterator():
            counts[r["place"]] = r["count"]
        parts = bounded_loads(counts, n_shards)
        where = spark.createDataFrame(parts, "place int, lo long, hi long, shard int, first long")
        d = d.withColumn("rank", (F.row_number().over(Window.partitionBy("place").orderBy("h", "doc_id", "text_crc32")) - 1).cast("long"))
        w = where.alias("w")
        d = d.join(F.broadcast(w), (d["place"] == F.col("w.place")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        d = d.withColumn("slot", F.col("first") + F.col("rank") - F.col("lo")).withColumn("grown_shard", F.lit(None).cast("int"))
    return d.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
