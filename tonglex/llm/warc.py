"""WARC archives as seekable Zstandard bundles: independent frames, a seek table in the footer, record numbers to places in frames.

A task writes its pages as WARC 1.1 records into bundles of its own, records following one another in frames of
about FRAME_BYTES that decompress alone. A bundle ends with the seek table of the public seekable format: a
skippable frame with the compressed and decompressed size of every frame. The index maps each record to bundle,
frame and offset inside the decompressed frame, so one record costs one read of one frame.

Bundles have names of their own for every attempt of a task, and only those of attempts that ended are in the
index, which Spark commits; what lost attempts left behind is deleted. The folder is opened by pyarrow.fs, so it
may be a shared file system or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, stage_table, table, with_totals, written_folder

FRAME_BYTES = 1 << 20  # of records, before compression; a frame holds one record at least
BUNDLE_BYTES = 1 << 30
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"  # pages carry no time
#: Fixed values of the public seekable format: magic number of the skippable frame that holds the table, magic number of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, offset long"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder) if re.match(r"\w+:", folder) else f"file://{folder}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records ------------------------------------------------------------------------------------


def response_id(page_id: int | None, key: str) -> str:
    """Of the one record that holds the payload of SHA-256 `key`."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{key}>"


def _one_line(x: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record_bytes(record_id: str, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit without. Either has the HTTP header, which states the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(record_id: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+):", record_id or "")
    return int(found[1]) if found else None


def parse_records(data: bytes) -> Iterator[dict]:
    """Records that follow one another in a decompressed frame; raises where one is damaged."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if not version.startswith("WARC/") or digest_of(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"damaged record at {at}")
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and digest_of(payload) != digest:
            raise ValueError(f"damaged payload at {at}")
        yield {
            "record_id": head["WARC-Record-ID"], "page_id": _page_of(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
            "refers_to": _page_of(head.get("WARC-Refers-To")), "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": digest, "payload": None if revisit else payload, "offset": at,
        }
        at = end + 4 + size + 4


# Bundles ------------------------------------------------------------------------------------


class BundleWriter:
    """Frames of records in one file, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.size = out, frame_bytes, 0
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.offset = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.pending and self.offset + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), self.offset
        self.pending.append(record)
        self.offset += len(record)
        return place

    def _end_frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.pending))
        self.out.write(packed)
        self.frames.append((len(packed), self.offset))
        self.size += len(packed)
        self.pending, self.offset = [], 0

    def close(self) -> None:
        if self.pending:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    width = 12 if flags & 0x80 else 8  # with checksums
    start = size - 9 - n * width - 8
    if magic != SEEKABLE or start < 0:
        raise ValueError("not a seekable bundle")
    file.seek(start)
    table_ = file.read(8 + n * width)
    if struct.unpack_from("<I", table_)[0] != SKIPPABLE:
        raise ValueError("damaged seek table")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table_, 8 + k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, place: int, packed: int, plain: int) -> bytes:
    file.seek(place)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(plain, 1))


# Spark --------------------------------------------------------------------------------------


def records_of(pages: DataFrame, least_bytes: int = 0, **bounds) -> DataFrame:
    """pages(page_id, url, html) -> what becomes a record: page_id, url, html (null for a revisit), key, size, first_id, revisit.

    Of payloads equal and of least_bytes or more, the row of the smallest page_id (nulls last), then url, is the response. Rows
    equal in page_id, url and html stand for one another: they are counted, one is the response and the others revisit it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("key", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    address = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    keys = p.where(F.col("size") >= least_bytes).groupBy("key", address.alias("a")).agg(F.count("*").alias("c"))
    keys = keys.groupBy("key").agg(F.sum("c").alias("n"), F.min(F.struct("a", "c")).alias("first")).where("n > 1")
    keys = stage_table(keys.select("key", "n", F.col("first.a").alias("first"), F.col("first.c").alias("same")), "payloads")
    j = with_totals(p, keys, "key", F.struct("page_id", "url"), **bounds)
    head = F.col("first").isNotNull() & (F.col("first") == address)
    plain = j.withColumn("revisit", F.col("first").isNotNull() & ~head)
    if not keys.where("same > 1").isEmpty():
        twins = plain.where(head & (F.col("same") > 1)).groupBy("key").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("html").alias("html"), F.first("size").alias("size"), F.first("first").alias("first"), F.first("same").alias("same"))
        twins = twins.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("same")))).withColumn("revisit", F.col("k") > 1).drop("k")
        plain = plain.where(~head | (F.col("same") == 1)).unionByName(twins)
    return plain.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "key", "size", F.col("first.page_id").alias("first_id"), "revisit", F.base64(F.unhex(F.sha1("html"))).alias("sha1"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, **bounds) -> DataFrame:
    """A record of every row of pages(page_id, url, html), in bundles in `folder`; the index of records, as a stage table.

    Defined results: a null html is an empty payload, a null url leaves the record without a target, a null page_id comes after all
    others and its record names none; repeated rows are records of their own, one of them the response; control characters of a url
    are percent-encoded; an empty table writes nothing; other columns are ignored. Payloads are not shuffled as long as the table of
    repeated ones can be broadcast; beyond that they are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(folder)
        writer, name = None, ""
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(where.open_output_stream(f"{top}/{name}", compression=None), frame_bytes)
                of_payload, refers_to = response_id(r["first_id"] if r["revisit"] else r["page_id"], r["key"]), None
                record_id = of_payload
                if r["revisit"] or r["size"] < least_bytes:
                    record_id = response_id(r["page_id"], uuid.uuid4().hex)
                    refers_to = of_payload if r["revisit"] else None
                digest = base64.b32encode(base64.b64decode(r["sha1"])).decode()
                record = record_bytes(record_id, r["url"], r["size"], digest, None if r["revisit"] else r["html"].encode(), refers_to)
                frame, offset = writer.add(record)
                index.append((record_id, r["page_id"], name, frame, offset, len(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            columns = list(zip(*index, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        if writer is not None:
            writer.close()

    where, top = opened(folder)
    where.create_dir(top, recursive=True)
    index = stage_table(map_arrow(records_of(pages, least_bytes, **bounds), run, INDEX), "records")
    _drop_lost(index, folder)
    return index


def _drop_lost(index: DataFrame, folder: str) -> None:
    """Delete bundles of attempts that did not end; there is a bundle or few for each task, never one for each record."""
    known = {r["bundle"] for r in index.select("bundle").distinct().collect()}
    where, top = opened(folder)
    for f in where.get_file_info(fs.FileSelector(top)):
        if f.base_name.endswith(".warc.zst") and f.base_name not in known:
            where.delete_file(f.path)


def frames_of(bundles: DataFrame, folder: str) -> DataFrame:
    """bundles(bundle) -> bundle, frame, place, packed, plain from the seek tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(folder)
        for batch in batches:
            rows = []
            for name in batch.column("bundle").to_pylist():
                with where.open_input_file(f"{top}/{name}") as file:
                    rows += [{"bundle": name, "frame": k, "place": a, "packed": b, "plain": c} for k, (a, b, c) in enumerate(seek_table(file))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("place", pa.int64()), ("packed", pa.int64()), ("plain", pa.int64())]))

    return map_arrow(bundles.select("bundle"), run, "bundle string, frame int, place long, packed long, plain long")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the frames that the rows of the index lie in, parsed and their digests verified; without payloads, if not asked for."""
    # frames are dealt out evenly, whatever the bundles' sizes
    frames = frames_of(index.select("bundle").distinct(), folder).join(index.select("bundle", "frame").distinct(), ["bundle", "frame"], "left_semi").repartition(F.col("bundle"), F.col("frame"))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(RECORD.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(folder)
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"])):
                with where.open_input_file(f"{top}/{r['bundle']}") as file:
                    data = read_frame(file, r["place"], r["packed"], r["plain"])
                more = {"bundle": r["bundle"], "frame": r["frame"]} | ({} if payloads else {"payload": None})
                yield pa.RecordBatch.from_pylist([x | more for x in parse_records(data)], schema)

    return map_arrow(frames, run, RECORD)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records of some rows of the index: only their frames are read."""
    return read_archives(index, folder).join(index.select("bundle", "frame", "offset"), ["bundle", "frame", "offset"], "left_semi")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    written_folder(spark, folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = " ".join(f"{i:05b}" for i in range(32))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, from_hex(sha1(payload))::BLOB::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((instr('{_BITS}', substr(bits, (5 * i + 1)::INTEGER, 5)) - 1) // 6 + 1)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
