"""Dictionary text as a data source: lines `traditional simplified [pin1 yin1] /gloss/gloss/`, # for remarks.

`spark.read.format("dictionary_text").load(path)` after register(spark). A file or a folder of files is split by
bytes, so a large one is read by many tasks; small splits beyond TASKS go to a task by several, up to SPLIT_BYTES together,
so that the number of tasks does not follow from the size of a split. The schema is fixed, and a line that does not fit is a row with its
text in `damaged` instead of an entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .lexicon import ENTRY

SCHEMA = "file string, place long, traditional string, simplified string, pinyin_numbers string, english array<string>, damaged string"
SPLIT_BYTES, TASKS, ROWS, STEP, TAIL = 16 << 20, 400, 4096, 1 << 20, 512
_LINE = re.compile(r"(\S+) (\S+) \[([^\]]+)\] /(.+)/\s*")
_MARKS = {v: v + m for v, m in zip("aeiouü", ("āáǎà", "ēéěè", "īíǐì", "ōóǒò", "ūúǔù", "ǖǘǚǜ"), strict=True)}


def with_mark(syllable: str) -> str:
    """A syllable with its tone number as a mark: on a or e, else on the o of ou, else on the last vowel; 5 has none."""
    tone = syllable[-1:]
    body = re.sub("u:|v", "ü", syllable[:-1]) if tone.isdigit() else syllable
    if tone not in ("1", "2", "3", "4"):
        return body
    low = body.lower()
    at = next((low.find(v) for v in ("a", "e", "ou") if v in low), max(map(low.rfind, "iouü")))
    return body if at < 0 else body[:at] + (_MARKS[low[at]][int(tone)] if body[at] == low[at] else _MARKS[low[at]][int(tone)].upper()) + body[at + 1 :]


@dataclass
class Task(InputPartition):
    """Stretches of files (file, start, end), each read in splits."""

    stretches: list[tuple[str, int, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match(r"\w+:", path) else fs.FileSystem.from_uri(f"file://{path}")


def _lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range; the first one after a cut belongs to the range before."""
    at = max(start - 1, 0)
    file.seek(at)
    rest, whole, left, tail = b"", start == 0, end - at, TAIL
    while True:
        if left > 0:
            data = file.read(min(STEP, left))
            left -= len(data)
        else:  # the last line goes on behind the range
            data = file.read(tail)
            tail = min(2 * tail, STEP)
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if whole:
                if at >= end:
                    return
                yield at, line
            whole, at = True, at + len(line) + 1
        if not data:
            if rest and whole and at < end:
                yield at, rest
            return
        if at >= end and whole:
            return


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Task]:
        where, top = _opened(self.path)
        info = where.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        together = min(SPLIT_BYTES, sum(f.size for f in files) // TASKS)
        splits = max(-(-together // self.split_bytes), 1)  # of a task
        out, free = [], 0
        for f in sorted(files, key=lambda f: f.path):
            start = 0
            while start < f.size:
                if not free:
                    out.append(Task([]))
                    free = splits
                end = min(start + free * self.split_bytes, f.size)
                out[-1].stretches.append((f.path, start, end))
                free -= -(-(end - start) // self.split_bytes)
                start = end
        return out or [Task([])]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

        for name, start, end in task.stretches:
            with _opened(self.path)[0].open_input_file(name) as file:
                for at, raw in (x for a in range(start, end, self.split_bytes) for x in _lines(file, a, min(a + self.split_bytes, end))):
                    text = raw.decode("utf-8", "replace").rstrip("\r")
                    if not text.strip() or text.startswith("#"):
                        continue
                    m = _LINE.fullmatch(text) if "�" not in text else None
                    rows.append((name, at, m[1], m[2], m[3], [g for g in m[4].split("/") if g], None) if m else (name, at, None, None, None, None, text))
                    if len(rows) >= ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class DictionaryText(DataSource):
    """Options: path; split_bytes, the bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "dictionary_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DictionaryText)


def entries_of(lines: DataFrame) -> DataFrame:
    """Entries of the lines that are none damaged: marks and tones from the numbers, ids from the hash of file and place."""

    @F.arrow_udf("string")
    def marks(numbers: pa.Array) -> pa.Array:
        return pa.array([None if n is None else " ".join(map(with_mark, n.split(" "))) for n in numbers.to_pylist()], pa.string())

    word_id = F.xxhash64("file", "place").bitwiseAND(F.lit((1 << 62) - 1))
    e = lines.where("damaged is null").select(
        "traditional", "simplified", marks("pinyin_numbers").alias("pinyin_marks"), "pinyin_numbers", "english",
        F.regexp_extract_all("pinyin_numbers", F.lit("[1-5]"), F.lit(0)).alias("tone_marks"), word_id.alias("hash"), F.array().alias("measure_words"), F.lit(1).alias("hsk"), word_id.alias("word_id"),
    )
    return e.select(*(F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in ENTRY))
