"""Ranked search, vector codes and archives against brute force: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tonglex.llm import lexical_search, vector_codes, warc

RNG = random.Random(5)


# 11 ----------------------------------------------------------------------------------------


def terms(text):
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_ranks(docs, items, k):
    counted = [(d if d is not None else -(1 << 63), Counter(terms(t or ""))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        scored = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s:
                scored.append((-s, d))
        out += [(item, r, d if d != -(1 << 63) else None, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made_docs():
    words = ["".join(RNG.choice("abcdeÄß中9") for _ in range(RNG.randint(1, 4))) for _ in range(150)]
    text = lambda n: RNG.choice([" ", "-", ". ", "_"]).join(RNG.choices(words, weights=range(len(words), 0, -1), k=n))
    rows = [(i, text(RNG.randint(1, 60))) for i in range(200)]
    copy = text(30)
    rows += [(1000 + i, copy) for i in range(70)]  # ties beyond the k-th place
    rows += [(None, text(9)), (None, None), (7, None), (8, ""), (9, "?! ."), (5, rows[5][1]), (5, rows[5][1]), (2000, text(40_000)), (2001, rows[3][1].upper())]
    items = [(i, text(RNG.randint(1, 25))) for i in range(20)] + [(30, copy), (31, None), (32, ""), (33, "--"), (34, "zzzunknown"), (None, text(4)), (3, "ab"), (35, copy), (35, copy)]
    return rows, items


@pytest.mark.parametrize("k, block", [(50, 1 << 20), (3, 300), (400, 1 << 20)])
def test_ranked_search(spark, documents, k, block):
    rows, items = made_docs()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n", F.lit("x"))
    got = lexical_search.rank_documents(documents(rows).repartition(7), bench, k, block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(rows, items, k)


def test_ranked_search_of_nothing(spark, documents):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lexical_search.rank_documents(documents([]), bench).count() == 0
    assert lexical_search.rank_documents(documents([(1, None), (2, "?")]), bench).count() == 0
    assert lexical_search.rank_documents(documents([(1, "some words")]), bench.where("false")).count() == 0


def test_bounds_hold_and_leave_few():
    """A byte bound is never under the exact share, and less than a step above it."""
    rng = np.random.default_rng(3)
    c = lexical_search.Corpus(1000, 123_456, rng.integers(0, 9000, 50))
    n, terms_, tfs = rng.integers(1, 5000, 400), rng.integers(0, 50, 400), rng.integers(1, 90, 400)
    exact = c.shares(n, np.arange(400), terms_, tfs)
    q = -(-exact // c.step)
    assert q.max() <= 255 and (q * c.step >= exact).all() and ((q - 1) * c.step < exact).all()
    assert int(exact[0]) == int(c.weights[terms_[0]]) * ((10**9 * int(tfs[0])) // (1000 * int(tfs[0]) + 20 * (50 + 50 * int(n[0]) * 1000 // 123_456)))


# 12 ----------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts or parts
    d = width // parts
    cut = [[[math.floor(4096 * x) for x in (list(v) + [0] * (width - len(v)))][p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], np.array(cut[r], "<i4").tobytes()))[:entries]
    books = [[list(cut[r][p]) for r in order] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e, p=p, x=x: (far(x[p], books[p][e]), e)) for p in range(parts)] for x in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(far(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(cut, codes, strict=True)]
    by = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, by[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("code", F.lit(1)).withColumn("entry", F.lit("x")).withColumn("n", F.lit(2))


@pytest.mark.parametrize("width, bounds", [(64, {}), (16, {"most_rows": 0}), (13, {})])
def test_vector_codes(spark, width, bounds):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], int(i) % 5 if i % 7 else None) for i in rng.permutation(250)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(60)]  # a common vector
    rows += [(300, None, 1), (301, [None] * width, 1), (302, [math.nan] * width, 1), (303, [1.0] * (width - 1) + [math.inf], 1), (None, rows[9][1], None), (5, rows[8][1], 9), (5, rows[8][1], 9)]
    rows += [(400, [], 3), (401, [0.5] * 5, 3), (402, [0.0] * width, 3), (403, [-1e-9] * width, None)]
    got = vector_codes.compress_vectors(vectors(spark, rows).repartition(5), **bounds)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 8, 16, 6)


def test_vector_codes_of_few_and_extreme(spark):
    few = [(2, [0.1] * 8, 1), (1, [0.1] * 8, None), (3, [9.0] * 8, 1)]
    assert sorted(map(tuple, vector_codes.compress_vectors(vectors(spark, few)).collect()), key=str) == brute_codes(few, 8, 16, 6)
    assert vector_codes.compress_vectors(vectors(spark, few).where("false")).count() == 0
    assert vector_codes.compress_vectors(vectors(spark, [(1, None, 1)])).count() == 0
    huge = vector_codes.compress_vectors(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]), entries=1).collect()
    assert len(huge) == 3 and all(0 <= r["error"] < 1 << 63 for r in huge)


@pytest.mark.parametrize("size", [1, 300, 100_000, 1 << 27])
def test_screening_never_loses_the_nearest(size):
    """Near ties of every magnitude: entries one unit apart, equal ones, vectors halfway between."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        d = int(rng.integers(1, 40))
        base = rng.integers(-size, size + 1, d)
        entries = np.stack([base + rng.integers(-1, 2, d) * int(rng.integers(0, 2)) for _ in range(9)] + [rng.integers(-size, size + 1, d) for _ in range(3)]).astype(np.int64)
        x = np.concatenate([base + rng.integers(-2, 3, (50, d)), rng.integers(-size, size + 1, (50, d)), (entries[:6] + entries[3:9]) // 2]).astype(np.int64)
        exact = np.array([[sum(int(a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries] for row in x], dtype=object)
        want = [min(range(len(entries)), key=lambda e, r=r: (r[e], e)) for r in exact]
        assert vector_codes.nearest(x, entries).tolist() == want
        may = vector_codes.overlapping(x, entries)
        assert all(may[i, w] for i, w in enumerate(want))
    far = vector_codes.overlapping(np.array([[0] * 8]), np.array([[0] * 8, [1000] * 8]))
    assert far.tolist() == [[True, False]]  # most entries are never measured again


# 13 ----------------------------------------------------------------------------------------


def brute_records(rows, least=0):
    """Of equal rows any one is the response."""
    groups = {}
    for i, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((i is None, i, url is not None, url or ""))
    out = []
    for b, own in groups.items():
        own.sort(key=lambda a: tuple(x if x is not None else 0 for x in a))
        for k, (_, i, _, _) in enumerate(own):
            revisit = k > 0 and len(b) >= least
            out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", own[0][1] if revisit else None))
    return sorted(out, key=str)


def made_pages():
    html = ["<p>" + "".join(RNG.choices("abc <é中", k=RNG.randint(0, 400))) + "\r\n\r\n</p>" for _ in range(40)]
    rows = [(i, f"https://a.b/{i}", RNG.choice(html)) for i in range(150)]
    rows += [(500 + i, None, html[0]) for i in range(60)] + [(None, "u", html[1]), (None, None, "only here"), (700, "u\r\nWARC-Type: x", None), (701, "", ""), (702, "v", None)]
    rows += [(7, "https://a.b/7", rows[7][2])] * 3 + [(-5, "twin", "twin")] * 4 + [(800, "long", "x" * 3_000_000), (801, "long", "x" * 3_000_000)]
    return rows


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("key", F.lit(1)).withColumn("first", F.lit("x")).withColumn("n", F.lit(2))


@pytest.mark.parametrize("least, bounds", [(0, {}), (200, {}), (0, {"most_rows": 0})])
def test_archives_come_back(spark, tmp_path, least, bounds):
    rows = made_pages()
    index = warc.write_archives(pages_of(spark, rows).repartition(6), str(tmp_path / "a"), least, frame_bytes=5000, bundle_bytes=20_000, **bounds)
    got = warc.read_archives(index, str(tmp_path / "a")).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows, least)
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) == len(rows) == index.count()
    texts = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    want = Counter((i, (html or "").encode()) for i, _, html in rows)
    assert Counter((r["page_id"], texts[r["payload_digest"]]) for r in got) == want
    places = {(r["record_id"], r["bundle"], r["frame"], r["offset"]) for r in index.collect()}
    assert places == {(r["record_id"], r["bundle"], r["frame"], r["offset"]) for r in got}


def test_bundles_are_plain_zstandard_and_seekable(spark, tmp_path):
    folder = tmp_path / "b"
    index = warc.write_archives(pages_of(spark, made_pages()), f"file:{folder}", frame_bytes=5000, bundle_bytes=20_000)
    files = sorted(folder.glob("*.warc.zst"))
    assert len(files) > 1
    for f in files:
        data = f.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()  # passes over the seek table
        frames = warc.seek_table(warc.opened(str(f.parent))[0].open_input_file(str(f)))
        assert b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + b]) for a, b, _ in frames) == whole
        assert sum(c for _, _, c in frames) == len(whole)
    some = index.where("page_id in (7, 800)")
    assert {r["page_id"] for r in warc.fetch(some, str(folder)).collect()} == {7, 800} and warc.fetch(some, str(folder)).count() == some.count()
    (folder / "pages-lost.warc.zst").write_bytes(b"half a")  # an attempt that did not end
    warc._drop_lost(index, str(folder))
    assert sorted(folder.glob("*.warc.zst")) == files


def test_archives_of_nothing_and_damage(spark, tmp_path):
    index = warc.write_archives(pages_of(spark, [(1, "u", "h")]).where("false"), str(tmp_path / "c"))
    assert index.count() == 0 and warc.read_archives(index, str(tmp_path / "c")).count() == 0
    record = warc.record_bytes("<urn:x-page:1:k>", "u", 3, warc.digest_of(b"abc"), b"abc", None)
    assert [r["payload"] for r in warc.parse_records(record * 2)] == [b"abc"] * 2
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_records(record.replace(b"abc", b"abd")))
