"""Secret scan: base patterns over the whole text, then a worklist that unwraps nested encodings.

A layer is a text plus, for each of its characters, the range of the document it came from.
Percent and Unicode escapes are undone over a whole layer; base64 runs, and what they
compress, open layers of their own; lines that base64 was wrapped into are one run more, and a run that does not
decode from its start is tried from its next three characters and behind each / _ and -. Every new layer is scanned and searched for further
layers until none is new; layers already seen end cycles.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, map_arrow, table

KINDS = ("assign", "access", "hex")
_FLAGS = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
#: Named references of the characters that secrets and what assigns them are made of.
_NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "equals": "=", "colon": ":", "plus": "+", "sol": "/", "period": ".", "lowbar": "_", "Tab": "\t", "NewLine": "\n"}
_NAME = re.compile(rf"&(?:{'|'.join(_NAMED)});")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
#: A decompressed stream is read in pieces of this many bytes that overlap, so a bomb cannot fill memory.
PIECE, OVERLAP, STEP = 16 << 20, 64 << 10, 64 << 10

Span = tuple[int, int, int]  # kind's number, start, end


def base_spans(text: str) -> list[Span]:
    """Base matches: leftmost, non-overlapping per kind; those too short are dropped after matching."""
    out: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # AKIA... of 20 and hex of 24 characters lie inside runs of 16 characters of a wider class
    akia = "AKIA" in text
    for r in _RUN.finditer(text):
        if r.end() - r.start() >= 20:
            if akia:
                out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text, r.start(), r.end()) if m.end() - m.start() >= 20]
            if r.end() - r.start() >= 24:
                out += [(2, m.start(), m.end()) for m in _HEX.finditer(text, r.start(), r.end()) if m.end() - m.start() >= 24]
    out.sort(key=lambda s: (s[1], s[0], s[2]))
    return out


class Layer:
    """A decoded text; character i came from [starts[i], ends[i]) of the document (a plain range: from all of it)."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return min(self.starts[a:b]), max(self.ends[a:b])


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of pattern decoded; decode gives characters and how many source characters each used."""
    parts, starts, ends, at = [], array("q"), array("q"), 0

    def kept(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if layer.starts is None:
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        elif isinstance(layer.starts, int):
            starts.extend(array("q", [layer.starts]) * (b - a))
            ends.extend(array("q", [layer.ends]) * (b - a))
        else:
            starts.extend(layer.starts[a:b])
            ends.extend(layer.ends[a:b])

    for m in pattern.finditer(layer.text):
        kept(at, m.start())
        k = m.start()
        for c, n in decode(m[0]):
            a, b = layer.source(k, k + n)
            parts.append(c)
            starts.extend([a] * len(c))
            ends.extend([b] * len(c))
            k += n
        at = m.end()
    if not at:
        return None
    kept(at, len(layer.text))
    return Layer("".join(parts), starts, ends)


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    return [(c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in raw.decode("utf-8", "surrogateescape")]


def _unescape(run: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for m in _ONE.finditer(run):
        n = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
        if out and 0xDC00 <= n <= 0xDFFF and len(out[-1][0]) == 1 and 0xD800 <= ord(out[-1][0]) <= 0xDBFF:
            high, used = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + (n - 0xDC00)), used + len(m[0])))
        else:
            out.append((chr(n) if n <= 0x10FFFF else "\ufffd", len(m[0])))
    return out


#: The first bytes of compressed streams, and what opens them (zlib's own header is checked by its sum).
_OPENERS = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", None))


def _opener(head: bytes):
    """What opens the stream that begins so (zstd: a function of its own); None if it does not look compressed."""
    for magic, opener in _OPENERS:
        if head.startswith(magic):
            return opener or _zstd
    if len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj
    return None


class _Chunks(io.RawIOBase):
    """An iterator of bytes as a file."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            self.rest = next(self.chunks, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _zstd(chunks: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(_Chunks(chunks), read_size=STEP, read_across_frames=True)
    try:
        while out := reader.read1(PIECE):
            yield out
    except zstandard.ZstdError:  # damaged: what came before the damage has been read
        return


def _fed(d, data: bytes) -> Iterator[bytes]:
    """Output of a decompressor for more input, PIECE bytes at a time."""
    while True:
        out = d.decompress(data, PIECE)
        data = getattr(d, "unconsumed_tail", b"")
        if out:
            yield out
        if d.eof or (not data and len(out) < PIECE):
            return


def _stream(opener, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a stream compresses, all its members one after the other; at damage, what precedes it (bz2 and xz: up to the last STEP bytes read)."""
    if opener is _zstd:
        yield from _zstd(chunks)
        return
    d, data = opener(), next(chunks, b"")
    while data:
        step, rest = data[:STEP], data[STEP:]
        saved = d.copy() if hasattr(d, "copy") else None
        done = 0
        try:
            for out in _fed(d, step):
                done += len(out)
                yield out
        except (zlib.error, OSError, lzma.LZMAError):
            if saved is not None:  # what the failing call held back comes byte by byte
                try:
                    for k in range(len(step)):
                        for out in _fed(saved, step[k : k + 1]):
                            new = out[min(done, len(out)) :]
                            done -= len(out) - len(new)
                            if new:
                                yield new
                except zlib.error:
                    return
            return
        if d.eof:
            rest = d.unused_data + rest
            if len(rest) < 6:
                rest += next(chunks, b"")
            opener = _opener(rest[:8])
            if opener is None or opener is _zstd:
                return
            d = opener()
        data = rest or next(chunks, b"")


def _deflate():
    return zlib.decompressobj(-15)


def _whole_deflate(raw: bytes, skip: int) -> bool:
    """Whether raw from skip on is one deflate stream without any header, of any size; what it unpacks to is looked at in steps and not kept."""
    d, at, some = _deflate(), skip, False
    try:
        while at < len(raw) and not d.eof:
            data = raw[at : at + STEP]
            at += len(data)
            while data and not d.eof:
                some |= bool(d.decompress(data, STEP))
                data = d.unconsumed_tail
        return d.eof and some and at >= len(raw) and not d.unused_data
    except zlib.error:
        return False


def _inflates(head: bytes) -> bool:
    """Whether the beginning of a layer unpacks as deflate without a header, to text or to something compressed."""
    try:
        out = _deflate().decompress(head, 4096)
    except zlib.error:
        return False
    return len(out) >= 6 and (_opener(out[:8]) is not None or _text_head(out) or _inflates(out))


def _text_head(head: bytes) -> bool:
    """Whether the beginning of a layer, perhaps cut inside a character, is text."""
    try:
        return _printable(head.decode("utf-8"))
    except UnicodeDecodeError as e:
        return e.start > len(head) - 4 and _printable(head[: e.start].decode("utf-8"))


def _printable(t: str) -> bool:
    t = t.strip("\0")
    return bool(t) and sum(c.isprintable() or c in "\t\r\n" for c in t) >= 0.9 * len(t)


def _other_text(raw: bytes) -> str | None:
    """Text of bytes that are no UTF-8: UTF-16 by its mark or its zeros, else Latin-1 if it is printable."""
    zeros = [raw[k::2].count(0) for k in (0, 1)]
    order = "utf-16-le" if raw[:2] == b"\xff\xfe" or 4 * zeros[1] > len(raw) else "utf-16-be" if raw[:2] == b"\xfe\xff" or 4 * zeros[0] > len(raw) else None
    try:
        t = raw.decode(order or "latin-1").removeprefix("\ufeff") if len(raw) >= 12 else ""
    except UnicodeDecodeError:
        return None
    return t if _printable(t) else None


def _texts(raw: bytes, skip: int = 0, plain: bool = True) -> Iterator[str]:
    """Texts inside raw from skip on: what it decompresses to, through several compressions, or else, if `plain`, itself if it is text.

    Compressed streams feed one another in pieces, so no layer is held as a whole; the digest of the beginning of each
    tells a stream that unpacks to itself.
    """
    chunks, head, seen, depth = (raw[a : a + STEP] for a in range(skip, len(raw), STEP)), raw[skip : skip + STEP], set(), 0
    opener = _opener(head)
    if opener is None and plain and not _is_text(raw, skip) and _whole_deflate(raw, skip):
        opener = _deflate
    while opener is not None:
        key = hashlib.sha256(head).digest()
        if key in seen:
            return
        seen.add(key)
        inner = _stream(opener, chunks)
        first = next(inner, None)
        if first is None:
            break
        for more in inner:  # a head long enough to tell
            first += more
            if len(first) >= STEP:
                break
        chunks, head, depth = itertools.chain([first], inner), first, depth + 1
        opener = _opener(head) or (_deflate if not _text_head(head) and _inflates(head) else None)
    if depth:
        tail = b""
        for c in chunks:
            tail += c
            while len(tail) >= PIECE:
                yield tail[:PIECE].decode("utf-8", "replace")
                tail = tail[PIECE - OVERLAP :]
        if tail:
            yield (_other_text(tail) if b"\0" in tail[:64] else None) or tail.decode("utf-8", "replace")
        return
    if plain and _is_text(raw, skip):
        yield raw[skip:].decode("utf-8")


def _is_text(raw: bytes, skip: int) -> bool:
    try:
        return _printable(raw[skip:].decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _text_starts(raw: bytes) -> np.ndarray:
    """For each place of raw, whether all bytes from there on are UTF-8 text; one pass over them, whatever the number of places asked for."""
    points = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bad = (points >= 0xDC80) & (points <= 0xDCFF)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[bad] = 1
    known, which = np.unique(points, return_inverse=True)
    fine = np.array([chr(c).isprintable() or chr(c) in "\t\r\n" for c in known.tolist()], dtype=bool)[which]
    behind = np.cumsum(fine[::-1])[::-1]
    good = behind >= 0.9 * np.arange(len(points), 0, -1)
    last = np.flatnonzero(bad)
    good[: last[-1] + 1 if len(last) else 0] = False
    out = np.zeros(len(raw) + 1, dtype=bool)
    out[(np.cumsum(size) - size)[good]] = True
    return out


def _wrapped(t: str) -> Iterator[list[tuple[int, int]]]:
    """Lines (start, end) of base64 that was wrapped: lines of one width, the first one perhaps longer, and a last one of that or less."""
    for m in _LINES.finditer(t):
        lines = [x.span() for x in _LINE.finditer(t, m.start(), m.end())]
        width = [b - a for a, b in lines]
        i = 0
        while i + 1 < len(lines):
            end = i + 1
            for w in {width[i], width[i + 1]}:
                j = i + 1
                while j < len(lines) and width[j] == w:
                    j += 1
                j += j < len(lines) and width[j] < w
                if 16 <= w <= width[i] and j - i > 1:
                    yield lines[i:j]
                    end = max(end, j)
            i = end


def _named(name: str) -> list[tuple[str, int]]:
    return [(_NAMED[name[1:-1]], len(name))]


def _may_open(head: bytes) -> bool:
    """Whether bytes that begin so can be text or compressed."""
    if _opener(head) is not None:
        return True
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start > len(head) - 4 and len(head) == 64  # a character that goes on behind the head
    return True


def _decoded(run: str) -> Iterator[tuple[int, str]]:
    """(characters skipped, text) of what base64 decodes to, from the run's start or else, by alignment, the first other place that gives a text.

    Each alignment is decoded once, and whether its bytes are text from a place on is found for all places at once, so
    time follows the run's length.
    """
    plain = run.replace("-", "+").replace("_", "/")
    raws: dict[int, bytes] = {}
    starts: dict[int, np.ndarray] = {}
    done: set[int] = set()
    for at in [0, *(i + 1 for i, c in enumerate(run) if c in "/_-"), 1, 2, 3]:
        k = at % 4
        if k in done or (at and len(run) - at < 16):
            continue
        if k not in raws:
            part = plain[k : len(plain) - ((len(plain) - k) % 4 == 1)]
            raws[k] = base64.b64decode(part + "=" * (-len(part) % 4))
        raw, skip, some = raws[k], (at - k) // 4 * 3, False
        if at and not _may_open(raw[skip : skip + 64]):
            continue
        for text in _texts(raw, skip, at < 4) if at < 4 or _opener(raw[skip : skip + 8]) is not None else ():
            some = True
            yield at, text
        if at >= 4 and not some:
            if k not in starts:
                starts[k] = _text_starts(raw)
            if starts[k][skip]:
                some = True
                yield at, raw[skip:].decode("utf-8")
        if not at and not some and (other := _other_text(raw)) is not None:
            yield 0, other  # a guess, so the search goes on
        if some and not at:
            return
        if some:
            done.add(k)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    t = layer.text
    if "%" in t and (x := _rewritten(layer, _PERCENT, _percent)):
        yield x
    if ("\\" in t or "&#" in t) and (x := _rewritten(layer, _ESCAPE, _unescape)):
        yield x
    if "&" in t and (x := _rewritten(layer, _NAME, _named)):
        yield x
    runs = [[m.span()] for m in _RUN.finditer(t)]
    for lines in [*runs, *(_wrapped(t) if "\n" in t else ())]:
        end = lines[-1][1]
        padding = len(t[end : end + 2]) - len(t[end : end + 2].lstrip("="))
        for skip, text in _decoded("".join(t[a:b] for a, b in lines)):
            for start, stop in lines:  # the place of the first character that was not skipped
                if skip < stop - start:
                    break
                skip -= stop - start
            yield Layer(text, *layer.source(start + skip, end + padding))


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """Base spans plus those found in unwrapped layers, mapped to the document."""
    found = set(base)
    seen = {hashlib.sha256(b"()" + text.encode("utf-8", "surrogatepass")).digest()}
    work = [_unwrapped(Layer(text))]  # layers are opened one at a time, depth first
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        place = (x.starts, x.ends) if isinstance(x.starts, int) else ()
        key = hashlib.sha256(repr(place).encode() + x.text.encode("utf-8", "surrogatepass")).digest()
        if key in seen or not x.text:
            continue
        seen.add(key)
        found.update((k, *x.source(a, b)) for k, a, b in base_spans(x.text))
        work.append(_unwrapped(x))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            t = text.as_py() or ""
            base = base_spans(t)
            every = all_spans(t, base)
            n = [sum(s[0] == k for s in base) for k in range(3)]
            rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: counts and digest of base matches, all spans in code points.

    Defined results: null and empty texts have no spans; null doc_ids and repeated rows stay;
    other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    return map_arrow(docs_of(docs), _scan, SCHEMA)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with every maximal run of spans replaced by a mark."""
    out, at, end = [], 0, -1
    for _, a, b in spans:  # by start
        if a > end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with all secrets in `text` replaced, and n_chars, if there is one, counted anew; other columns stay, nulls too."""
    d = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column("text"):
                t = x.as_py()
                spans = all_spans(t, base_spans(t)) if t else []
                texts.append(redacted(t, spans) if spans else t)
            at = batch.schema.get_field_index("text")
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = map_arrow(docs, run, d)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(d["n_chars"].dataType)
        out = out.withColumn("n_chars", counted)
    return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
