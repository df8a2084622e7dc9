"""Segmentation of texts by their own words and pairs of neighbouring words, as headwords of up to some characters.

A headword is a word, or two neighbouring words with a space between, behind a space. Words are what separators (space, line
feed, tab) leave. Where such headwords come from the texts themselves, a text alone decides most places: two words of a
text that fit, with one space between, are a headword, and no longer one can start there, because none has a separator
behind its second word. What is left asks which prefixes of a window are headwords: where the second word is too
long for the two to fit, so that a shorter word may stand for it, and where the first word is too long by itself.

Windows and the different headwords of a slice of texts are dealt into buckets by the first characters that a headword and a
window have to share, as compressed blocks of lines. A task finds the longest headword of each window; the answers go
back to their texts, and tasks choose in place: a hit either ends within its own word or within the next one, so of a run of
hits that reach into the next word every second one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonglex.functions.spans import Filter, _mixed

try:
    from _md5 import md5  # half the time of hashlib's for so few bytes
except ImportError:
    from hashlib import md5

SLICE_BYTES = 8 << 20  # of text that a task looks at together
ROUTE = 3  # characters of a single word that name its bucket
BUCKET_BYTES = 8 << 20  # of input files for which there is a bucket
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 10, 9]] = True
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)


def _prints(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of spans of bytes, two uint64 each; eight bytes have to follow the last span."""
    eights = np.ndarray(max(len(data) - 7, 0), dtype="<u8", buffer=data, strides=(1,))
    hi, lo = (size.astype(np.uint64) * s for s in _SEEDS)
    k, rows = 0, None
    while True:
        at, left = (start, size) if rows is None else (start[rows], size[rows])
        block = eights[at + 8 * k]
        short = np.clip(8 * (8 - (left - 8 * k)), 0, 63).astype(np.uint64)
        block = (block << short) >> short
        if rows is None:
            hi, lo = _mixed(hi ^ block), _mixed(lo + block * _SEEDS[0])
        else:
            hi[rows], lo[rows] = _mixed(hi[rows] ^ block), _mixed(lo[rows] + block * _SEEDS[0])
        k += 1
        more = left > 8 * k
        if not more.any():
            return hi, lo
        rows = np.flatnonzero(more) if rows is None else rows[more]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members of spans, one after another."""
    gone = np.cumsum(size) - size
    return np.repeat(start - gone, size) + np.arange(int(size.sum()))


class Characters:
    """UTF-8 bytes by characters."""

    def __init__(self, data: np.ndarray):
        begins = (data & 0xC0) != 0x80
        self.plain = bool(begins.all())
        if not self.plain:
            self.before = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum(begins, out=self.before[1:])
            self.places = np.append(np.flatnonzero(begins), len(data))

    def count(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start if self.plain else (self.before[end] - self.before[start]).astype(np.int64)

    def size(self, start: np.ndarray, n) -> np.ndarray:
        """Bytes of n characters from each start on."""
        return np.broadcast_to(np.asarray(n, dtype=np.int64), start.shape) if self.plain else self.places[self.before[start] + n] - start


@dataclass
class Words:
    """Words of some texts in order. data: their bytes with one space behind each; raw: the texts' own bytes, a line feed behind each text."""

    raw: np.ndarray
    begin: np.ndarray  # in raw
    data: np.ndarray
    start: np.ndarray  # in data
    size: np.ndarray  # bytes
    text: np.ndarray  # which text
    bounds: np.ndarray  # words before each text
    place: np.ndarray  # whether a space is before
    near: np.ndarray  # whether one space is between it and the next word of its text
    followed: np.ndarray  # whether there is a next word in its text

    @staticmethod
    def of(texts: pa.Array) -> Words:
        large = pa.large_string()
        joined = pc.binary_join_element_wise(texts.cast(large).fill_null(""), pa.scalar("", large), pa.scalar("\n", large))
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        apart = _SEPARATOR[raw]
        edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edges = np.concatenate([[0], edges])
        begin, end = edges[0::2], edges[1::2]
        size = end - begin
        bounds = np.searchsorted(begin, offsets)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        apart[end] = False
        data = np.zeros(int(size.sum()) + len(size) + 8, dtype=np.uint8)
        data[:-8] = raw[~apart]
        start = np.cumsum(size + 1) - size - 1
        data[start + size] = 32
        next_begin, next_text = (np.append(x[1:], -1) for x in (begin, text)) if len(begin) else (begin, text)
        return Words(raw, begin, data, start, size, text, bounds, (begin > 0) & (raw[begin - 1] == 32), (raw[end] == 32) & (next_begin == end + 1), next_text == text)

    @cached_property
    def by_character(self) -> Characters:
        return Characters(self.data)

    @cached_property
    def length(self) -> np.ndarray:
        return self.by_character.count(self.start, self.start + self.size)

    @cached_property
    def both(self) -> np.ndarray:
        """Characters of a word and the next, with the space between."""
        return self.length + 1 + np.append(self.length[1:], 0) if len(self.length) else self.length

    def both_size(self, i: np.ndarray) -> np.ndarray:
        return self.size[i] + 1 + self.size[i + 1]

    def single(self, most: int) -> np.ndarray:
        return self.length <= most

    def pair(self, most: int) -> np.ndarray:
        return self.followed & (self.both <= most)

    def asking(self, most: int) -> np.ndarray:
        """Words whose longest headword the text does not decide; the first `most` characters from them on do."""
        return np.flatnonzero(self.place & ((self.length > most) | (self.near & (self.length + 2 <= most) & (self.both > most))))


def _once(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each, number of each among them) of fingerprints."""
    order = np.argsort(hi)
    new = np.ones(len(hi), dtype=bool)
    new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    if (hi[order[1:]] == hi[order[:-1]])[new[1:]].any():  # first values of different spans are the same
        order = np.lexsort((lo, hi))
        new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    number = np.empty(len(hi), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _most_once(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Places of fingerprints, of equal ones hardly ever more than one; without sorting."""
    slots = 1 << max(len(hi).bit_length() + 1, 4)
    slot = (hi & np.uint64(slots - 1)).view(np.int64)
    own, last = np.arange(len(hi), dtype=np.int32), np.zeros(slots, dtype=np.int32)
    last[slot] = own
    last = last[slot]
    return np.flatnonzero((last == own) | (hi[last] != hi) | (lo[last] != lo))


def _routes(data: np.ndarray, chars: Characters, start: np.ndarray, first: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (of few bits, which sort faster) of headwords or windows from their starts, sizes of their first words in bytes and in characters: by the first word and a
    character of the second, where there is one (length is -1), else by the first characters."""
    size = np.empty(len(start), dtype=np.int64)
    two = length < 0
    second = start[two] + first[two] + 1
    size[two] = first[two] + 1 + chars.size(second, 1)
    size[~two] = chars.size(start[~two], np.minimum(length[~two], ROUTE))
    return (_prints(data, start, size)[0] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def _packed(a: bytes) -> bytes:
    return pa.compress(a, codec="zstd", asbytes=True) if a else b""


def _lines(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Spans as lines; no span has a line feed."""
    out = data[_spread(start, size + 1)]
    out[np.cumsum(size + 1) - 1] = 10
    return out.tobytes()


def _cut(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its members of order), which is sorted by bucket."""
    if len(order):
        heads = np.flatnonzero(np.concatenate([[True], bucket[order[1:]] != bucket[order[:-1]]]))
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            yield int(bucket[order[a]]), order[a:b]


def _blocks(words: Words, ids: tuple[np.ndarray, np.ndarray], most: int, buckets: int) -> dict[int, list]:
    """By bucket: sizes before compression and compressed lines of headwords and of windows, and of who asks: window, text, word in the text."""
    chars, data = words.by_character, words.data
    one, two = np.flatnonzero(words.single(most)), np.flatnonzero(words.pair(most))
    start = np.concatenate([words.start[one], words.start[two]])
    size = np.concatenate([words.size[one], words.both_size(two)])
    kept = _most_once(*_prints(data, start, size))
    start, size, word = start[kept], size[kept], np.concatenate([one, two])[kept]
    bucket = _routes(data, chars, start, words.size[word], np.where(kept < len(one), words.length[word], -1), buckets)
    out: dict[int, list] = {}
    for b, i in _cut(np.argsort(bucket, kind="stable"), bucket):
        out.setdefault(b, [b"", b"", b"", b""])[0] = _lines(data, start[i], size[i])
    ask = words.asking(most)
    first, number = _once(*(x.view(np.uint64) for x in ids))
    ask = ask[first[number[words.text[ask]]] == words.text[ask]]  # of equal rows one asks
    if len(ask):
        start, alone = words.start[ask], words.length[ask] > most
        size = chars.size(start, most)
        # a long word's headwords of few characters are in buckets of their own
        who = np.concatenate([np.arange(len(ask)), *[np.flatnonzero(alone)] * (ROUTE - 1)])
        length = np.concatenate([np.where(alone, ROUTE, -1), *[np.full(int(alone.sum()), n) for n in range(1, ROUTE)]])
        bucket = _routes(data, chars, start[who], words.size[ask][who], length, buckets)
        hi, lo = _prints(data, start, size)
        for b, i in _cut(np.argsort(bucket, kind="stable"), bucket):
            i = who[i]
            first, number = _once(hi[i], lo[i])
            text = words.text[ask[i]]
            askers, text_number = np.unique(text, return_inverse=True)
            place = ask[i] - words.bounds[text]
            parts = out.setdefault(b, [b"", b"", b"", b""])
            parts[1] = _lines(data, start[i[first]], size[i[first]])
            parts[2] = np.stack([ids[0][askers], ids[1][askers]]).astype(np.int64).tobytes()
            parts[3] = np.stack([number, text_number, place]).astype(np.int32).tobytes()
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes, or of one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.column(column).nbytes > most:
                todo += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            elif b.num_rows:
                yield b


def _read(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of lines."""
    data = np.frombuffer(b"".join(lines) + bytes(8), dtype=np.uint8)
    end = np.flatnonzero(data[:-8] == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    return data, start, end - start


def _longest(keys: list[bytes], windows: list[bytes], most: int) -> np.ndarray:
    """Characters of the longest headword that each window starts with; 0: none that has a part of its last word."""
    data, start, size = _read(windows)
    hi, lo = _prints(data, start, size)
    first, number = _once(hi, lo)
    start = start[first]
    own, begin, length = _read(keys)
    key_hi, key_lo = _prints(own, begin, length)
    kept, _ = _once(key_hi, key_lo)  # by first value
    key_hi, key_lo = key_hi[kept], key_lo[kept]
    bits = np.zeros(Filter.size(len(kept), 1 << 28), dtype=np.uint64)
    word, bit = Filter.bits(key_hi, len(bits))
    np.bitwise_or.at(bits, word, bit)
    known, chars = Filter(bits), Characters(data)
    # a window of two words asks for headwords of two words
    space = np.flatnonzero(data == 32)
    at = np.minimum(np.searchsorted(space, start), max(len(space) - 1, 0))
    end = start + chars.size(start, most)
    two = (space[at] >= start) & (space[at] < end) if len(space) else np.zeros(len(start), dtype=bool)
    least = np.ones(len(start), dtype=np.int64)
    if two.any():
        least[two] = chars.count(start[two], space[at[two]]) + 2
    out = np.zeros(len(start), dtype=np.int8)
    for n in range(most, 0, -1):
        open_ = np.flatnonzero((out == 0) & (least <= n))
        hi, lo = _prints(data, start[open_], chars.size(start[open_], n))
        maybe = known.found(hi)
        open_, hi, lo = open_[maybe], hi[maybe], lo[maybe]
        i, found = np.searchsorted(key_hi, hi), np.zeros(len(open_), dtype=bool)
        left = np.flatnonzero(i < len(key_hi))
        while len(left):
            left = left[key_hi[i[left]] == hi[left]]
            found[left] |= key_lo[i[left]] == lo[left]
            i[left] += 1
            left = left[(i[left] < len(key_hi)) & ~found[left]]
        out[open_[found]] = n
    return out[number]


def _answers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(hi, lo, found) from all blocks of a bucket: found holds places of words of a text and characters, as int32."""
    rows: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            rows.setdefault(r["bucket"], []).append(r)
    for blocks in rows.values():
        full = lambda name: [pa.decompress(b[name], b[name + "_size"], codec="zstd", asbytes=True) if b[name] else b"" for b in blocks]  # noqa: E731, B023
        windows = full("windows")
        if not any(windows):
            continue
        n = _longest(full("keys"), windows, most)
        askers, who, before, met = full("askers"), full("who"), 0, []
        for w, a, x in zip(windows, askers, who, strict=True):
            ids, (number, text, place) = np.frombuffer(a, dtype=np.int64).reshape(2, -1), np.frombuffer(x, dtype=np.int32).reshape(3, -1)
            got = n[before + number] if len(number) else n[:0]
            hit = np.flatnonzero(got)
            if len(hit):
                hit = hit[np.argsort(text[hit], kind="stable")]
                met.append((ids[:, text[hit]], place[hit], got[hit]))
            before += w.count(b"\n")
        for ids, place, got in met:
            new = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)]))
            both = np.stack([place, got.astype(np.int32)], axis=1).astype(np.int32)
            sizes = 8 * np.append(new, len(place))
            found = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(both.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids[0, new]), pa.array(ids[1, new]), found], names=["hi", "lo", "found"])


def _chosen(words: Words, found: list[list[bytes] | None], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bytes, characters) of the hits that are kept, without the space before."""
    n, size = words.length.copy(), words.size.copy()
    two = np.flatnonzero(words.near & words.place & words.pair(most))
    n[two], size[two] = words.both[two], words.both_size(two)
    n[(words.length > most) | ~words.place] = 0
    filled = [(t, f) for t, f in enumerate(found) if f]
    if filled:
        parts = [np.frombuffer(b"".join(f), dtype=np.int32).reshape(-1, 2) for _, f in filled]
        at = np.concatenate(parts).astype(np.int64)
        word = np.repeat([words.bounds[t] for t, _ in filled], [len(p) for p in parts]) + at[:, 0]
        order = np.lexsort((at[:, 1], word))  # of several answers for a word the longest comes last
        word, got = word[order], at[order, 1]
        last = np.concatenate([word[1:] != word[:-1], [True]])
        word, got = word[last], got[last]
        n[word], size[word] = got, words.by_character.size(words.start[word], got)
    reaching = n > words.length  # into the next word
    i = np.arange(len(n))
    reached = np.concatenate([[False], reaching[:-1]])
    kept = ((i - np.maximum.accumulate(np.where(reached, 0, i))) % 2 == 0) & (n > 0) if len(n) else reaching
    word = np.flatnonzero(kept)
    return word, size[word], n[word]


def _buckets(df: DataFrame) -> int:
    """As many as Spark's shuffles have partitions or the input has splits, and one for every BUCKET_BYTES of its files at least."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = known // BUCKET_BYTES if known < 1 << 50 else 0  # unknown sizes are given as very large
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), by_size)


def phrase_digests(df: DataFrame, doc: str, text: Column, most: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc, n_tokens, n_chars, digest) of each row of df whose text has a token; a headword has `most` characters with the space before.
    digest: the sum of the first 32 bits of the MD5 of `place:token`."""
    most -= 1
    d = df.select(F.col(doc).alias("_d"), F.coalesce(text, F.lit("")).alias("_t"))
    # equal rows get equal answers, whichever task reads them
    d = d.select("_d", "_t", F.xxhash64("_d", "_t").alias("hi"), F.xxhash64(F.lit(1), "_t", "_d").alias("lo"))
    buckets = _buckets(df)
    names = ["keys", "windows", "askers", "who"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_t", slice_bytes):
            made = _blocks(Words.of(batch.column("_t")), (batch.column("hi").to_numpy(), batch.column("lo").to_numpy()), most, buckets)
            if made:
                cols = [pa.array(list(made), pa.int32())]
                for k in range(len(names)):
                    cols += [pa.array([_packed(p[k]) for p in made.values()], pa.binary()), pa.array([len(p[k]) for p in made.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", *[x for n in names for x in (n, n + "_size")]])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answers(batches, most)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_t", slice_bytes):
            words = Words.of(batch.column("_t"))
            word, size, n = _chosen(words, batch.column("found").to_pylist(), most)
            if not len(word):
                continue
            row, begin, raw = words.text[word], words.begin[word] - 1, words.raw.tobytes()
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            number = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            front = [b"%d:" % k for k in range(int(number.max()) + 1)]
            sums = b"".join([md5(front[k] + raw[a:b]).digest()[:4] for k, a, b in zip(number.tolist(), begin.tolist(), (begin + 1 + size).tolist(), strict=True)])
            total = lambda x: pa.array(np.add.reduceat(x, heads), pa.int64())  # noqa: E731, B023
            cols = [batch.column("_d").take(pa.array(row[heads])), total(np.ones(len(row), np.int64)), total(n + 1), total(np.frombuffer(sums, dtype=">u4").astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n_tokens", "n_chars", "digest"])

    blocks = d.select("hi", "lo", "_t").mapInArrow(dealt, "bucket int, " + ", ".join(f"{n} binary, {n}_size long" for n in names))
    answers = blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(settled, "hi long, lo long, found binary")
    whole = d.join(answers.groupBy("hi", "lo").agg(F.collect_set("found").alias("found")), ["hi", "lo"], "left")
    long = lambda name: T.StructField(name, T.LongType())
    out = whole.select("_d", "_t", "found").mapInArrow(digests, T.StructType([T.StructField("doc", d.schema["_d"].dataType), *map(long, ("n_tokens", "n_chars", "digest"))]))
    return out.withColumnRenamed("doc", doc)
