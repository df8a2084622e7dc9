"""Longest-match joins of texts with keys of any number.

Keys are known by fingerprints of their prefixes. Two filters of bounded size go to the tasks: one of some
prefixes where a longer key may go on (the rungs of a ladder), one of whole keys. A task climbs from every place
of a text where a key's first character is, while the prefixes are in the first filter; spans that are in the second
may be keys.

The different fingerprints of such spans, pre-aggregated by the tasks, are joined to the keys. What is none of them was
let through by mistake. Few mistakes go to the tasks as they are. Of many, a filter is made, and of the keys that are
also in it another, and so on by turns, each of a small part of the set before, until few are left to be sent as they
are. Tasks now know every hit for sure and choose in place. Texts and places are never shuffled.

Where even that does not thin the sets out (filters are of bounded size, keys are not), places with fingerprints are joined to
the keys, and the choice is made by joins as well (greedy_kept): a hit that no earlier one reaches into is always
kept, and from it the next kept ones follow along links to the first hit behind each; links grow fourfold a round
until no new hit is reached. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonglex.functions.automaton import greedy
from tonglex.functions.spans import Filter, Spans, code_points, turned
from tonglex.sources.staged import dropped, staged

FILTER_BYTES = 64 << 20  # of each filter; a quarter of that for rungs
MISTAKES = 1 << 20  # fingerprints that tasks are sent as they are
SEGMENT = 1 << 19  # places of one set of running sums
SLICE_BYTES = 4 << 20
AT_ONCE = 1 << 21  # spans whose fingerprints a task compares
JOINER = "%20"  # between the words of an English key
CHUNK = 1 << 16  # places of a text that are looked at together
HOT, HOT_KEYS, SALTS = 500, 256, 32


# Keys ---------------------------------------------------------------------------------------


@dataclass
class Ladder:
    """What tasks know of the keys: lengths (None: words are counted), which of them are rungs, first characters by code point, and
    the two filters. Keys of words have a rung before every JOINER and at the end."""

    lengths: list[int] | None
    steps: list[int]
    first: np.ndarray
    rungs: Filter
    whole: Filter


def _steps(lengths: list[int]) -> list[int]:
    """Rungs of keys of these lengths: each at least twice as long as the one before; the longest keys need none."""
    out: list[int] = []
    for n in lengths[:-1]:
        if not out or n >= 2 * out[-1]:
            out.append(n)
    return out


def _word_rungs(key: str) -> list[int]:
    """Ends of the prefixes of a key of words that are rungs, the whole key last."""
    out, at = [], key.find(JOINER)
    while at >= 0:
        out.append(at)
        at = key.find(JOINER, at + 1)
    return [n for n in out if n] + [len(key)]


def _rung_prints(keys: list[str], steps: list[int] | None) -> np.ndarray:
    """First values of the fingerprints of all rungs of some keys; steps: their lengths, None for keys of words."""
    points, starts = code_points(keys)
    if steps is None:
        ends = [_word_rungs(k) for k in keys]
        begin = np.repeat(starts[:-1], [len(e) for e in ends])
        return Spans(points).part(0, begin, begin + np.array([n for e in ends for n in e], dtype=np.int64))
    spans, size = Spans(points), np.diff(starts)
    return np.concatenate([spans.part(0, own, own + n) for n in steps for own in [starts[:-1][size >= n]]] or [np.zeros(0, np.int64)])


def _cells(values: np.ndarray, words: int, offset: int = 0) -> pa.RecordBatch:
    """(cell, bits) of a filter with these values, a row for each word that has any."""
    word, bits = Filter.bits(np.unique(values), words)
    order = np.argsort(word, kind="stable")
    cells, heads = np.unique(word[order], return_index=True)
    bits = np.bitwise_or.reduceat(bits[order], heads) if len(heads) else bits
    return pa.RecordBatch.from_arrays([pa.array(cells + offset), pa.array(bits.view(np.int64))], names=["cell", "bits"])


def _gathered(cells: DataFrame, words: int) -> np.ndarray:
    """The words of a filter from (cell, bits) of its parts."""
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes, or of one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and (b.column(column).nbytes > SLICE_BYTES or b.num_rows > 4096):
                todo += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            elif b.num_rows:
                yield b


def ladder_of(own: DataFrame, by_words: bool = False, filter_bytes: int = FILTER_BYTES) -> tuple[Broadcast, int]:
    """(Ladder in a broadcast variable, longest key) of own(key, hi, lo), no key empty: only key lengths, first characters and the bits
    of the filters come to the driver."""
    if by_words:
        rungs = F.size(F.split("key", JOINER)).cast("long")
        lengths, steps, n, rungs = None, None, *own.agg(F.count("*"), F.coalesce(F.sum(rungs), F.lit(0))).first()
        longest, first = 0, []
    else:
        counts = sorted((r["n"], r["count"]) for r in own.groupBy(F.length("key").alias("n")).count().collect())
        lengths, n = [k for k, _ in counts], sum(c for _, c in counts)
        steps = _steps(lengths)
        rungs = sum(c * sum(s <= k for s in steps) for k, c in counts)
        longest = max(lengths, default=0)
        first = [ord(r["c"]) for r in own.select(F.substring("key", 1, 1).alias("c")).distinct().collect()]
    of_rungs, of_whole = Filter.size(rungs, filter_bytes // 4), Filter.size(n, filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in _sliced(batches, "key"):
            yield _cells(batch.column("hi").to_numpy(), of_whole, of_rungs)
            if steps != []:
                found.append(np.unique(_rung_prints(batch.column("key").to_pylist(), steps)))
            if sum(map(len, found)) >= AT_ONCE:
                found = [np.unique(np.concatenate(found))]
                if len(found[0]) >= AT_ONCE // 2:
                    yield _cells(found.pop(), of_rungs)
        if found:
            yield _cells(np.concatenate(found), of_rungs)

    words = _gathered(own.select("key", "hi").mapInArrow(run, "cell long, bits long"), of_rungs + of_whole) if n else np.zeros(of_rungs + of_whole, dtype=np.uint64)
    known = np.zeros(max(first, default=0) + 2, dtype=bool)  # the last one is for characters beyond
    known[first] = True
    return own.sparkSession.sparkContext.broadcast(Ladder(lengths, steps or [], known, Filter(words[:of_rungs].copy()), Filter(words[of_rungs:].copy()))), longest


def _with_prints(keys: DataFrame) -> DataFrame:
    """keys with the columns hi and lo of the whole key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "key"):
            points, starts = code_points(batch.column("key").to_pylist())
            prints = Spans(points).prints(starts[:-1], starts[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, prints)], names=[*batch.schema.names, "hi", "lo"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))


@dataclass
class Prepared:
    """Keys ready to be matched any number of times: with their fingerprints, what tasks are sent, and the longest."""

    own: DataFrame
    ladder: Broadcast
    longest: int


def with_fingerprints(keys: DataFrame) -> DataFrame:
    """(key, hi, lo) of the different keys; none for an empty key."""
    return _with_prints(keys.select("key").where("key <> ''").distinct())


def prepared(own: DataFrame, words: int = 0, filter_bytes: int = FILTER_BYTES) -> Prepared:
    """own(key, hi, lo), which is read again for every use."""
    return Prepared(own, *ladder_of(own, bool(words), filter_bytes))


# Texts --------------------------------------------------------------------------------------


def _climb(spans: Spans, starts: np.ndarray, end_at: Callable, rungs: list[bool], ladder: Ladder) -> Iterator[tuple]:
    """(place in starts, level, hi, lo) of spans that may be keys. rungs: whether each level is one. end_at(level, places): ends, -1
    where a text has none."""
    alive, begun = np.arange(len(starts)), spans.begun(0, starts)
    for k, rung in enumerate(rungs):
        ends = end_at(k, alive)
        on = ends >= 0
        if not on.all():
            alive, ends, begun = alive[on], ends[on], (begun[0][on], begun[1][on])
        hi = spans.ended(0, begun, starts[alive], ends)
        if rung:
            on = ladder.rungs.found(hi)
            if len(on) < len(alive):
                alive, ends, hi, begun = alive[on], ends[on], hi[on], (begun[0][on], begun[1][on])
        if not len(alive):
            return
        hit = ladder.whole.found(hi)
        yield alive[hit], k, hi[hit], spans.part(1, starts[alive[hit]], ends[hit])


def character_probes(texts: list[str], ladder: Ladder) -> Iterator[tuple]:
    """(row, place, length, hi, lo) arrays: spans of the keys' lengths at every character that a key begins with."""
    points, first = code_points(texts)
    lengths = np.array(ladder.lengths, dtype=np.int64)
    rungs = [n in ladder.steps for n in ladder.lengths]
    for a in range(0, len(points), SEGMENT) if len(lengths) else ():
        b = min(a + SEGMENT, len(points))
        starts = np.flatnonzero(ladder.first[np.minimum(points[a:b], len(ladder.first) - 1)])
        row = np.searchsorted(first, starts + a, side="right") - 1
        limit = first[row + 1] - a

        def end_at(k, places, starts=starts, limit=limit):
            ends = starts[places] + lengths[k]
            return np.where(ends <= limit[places], ends, -1)

        for at, k, hi, lo in _climb(Spans(points[a : b + lengths[-1]]), starts, end_at, rungs, ladder):
            yield row[at], starts[at] + a - first[row[at]], np.full(len(at), lengths[k]), hi, lo


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of normalised texts, their words joined as in keys; row, number in its text, start and end of each word)."""
    split = [[w for w in t.split(" ") if w] for t in texts]
    points, first = code_points([JOINER.join(ws) for ws in split])
    count = np.array([len(ws) for ws in split], dtype=np.int64)
    before = np.cumsum(count) - count
    size = np.array([len(w) for ws in split for w in ws], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), count)
    word = np.arange(len(size)) - before[row]
    gone = np.cumsum(size) - size  # sizes of words before, over all texts
    start = first[row] + gone - (gone[before[row]] if len(size) else 0) + len(JOINER) * word
    return points, row, word, start, start + size


def word_probes(texts: list[str], ladder: Ladder, most: int) -> Iterator[tuple]:
    """(row, word, words, hi, lo) arrays: runs of up to `most` words of normalised texts, joined as in keys."""
    points, row, word, start, end = word_places(texts)
    a = 0
    while a < len(start):
        b = max(int(np.searchsorted(start, start[a] + SEGMENT)), a + 1)
        base, last = int(start[a]), int(end[min(b + most, len(end)) - 1])

        def end_at(k, places, a=a, base=base):
            at = np.minimum(a + places + k, len(end) - 1)
            return np.where((a + places + k < len(end)) & (row[at] == row[a + places]), end[at] - base, -1)

        for at, k, hi, lo in _climb(Spans(points[base:last]), start[a:b] - base, end_at, [True] * most, ladder):
            yield row[a + at], word[a + at], np.full(len(at), k + 1), hi, lo
        a = b


def probes(df: DataFrame, doc: str, text: Column, ladder: Broadcast, words: int = 0) -> DataFrame:
    """(row, doc, p, n, hi, lo) of all spans that may be keys; row tells the rows of df apart, whatever their ids.

    The result is to be written before it is used twice: row is of the task that reads the text. words: the most words of a
    key, for texts of normalised words; 0: every character is a place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = ladder.value, TaskContext.get().partitionId() << 40
        for batch in _sliced(batches, "_t"):
            texts = batch.column("_t").fill_null("").to_pylist()
            for at, p, n, hi, lo in word_probes(texts, known, words) if words else character_probes(texts, known):
                if len(at):
                    cols = [pa.array(row + at), batch.column("_d").take(pa.array(at)), pa.array(p, pa.int64()), pa.array(n, pa.int32()), pa.array(hi), pa.array(lo)]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "doc", "p", "n", "hi", "lo"])
            row += batch.num_rows

    long = lambda name: T.StructField(name, T.LongType())
    d = df.select(F.col(doc).alias("_d"), text.alias("_t"))
    return d.mapInArrow(run, T.StructType([long("row"), T.StructField("doc", d.schema["_d"].dataType), long("p"), T.StructField("n", T.IntegerType()), long("hi"), long("lo")]))


def hot_join(left: DataFrame, on: str, right: DataFrame, spread: list[str], keyed: bool = False) -> DataFrame:
    """left joined to right on the column `on`, where few values may hold many rows of left: those of over 1 / HOT of the rows, as
    an approximate count finds them, are dealt over SALTS tasks by the columns `spread`, and their rows of right copied to each.
    keyed: right is laid out by `on`; it stays where it is, and only its rows of the heavy values are read again and copied."""
    n, top = left.select(F.count("*").alias("n"), F.expr(f"approx_top_k({on}, {HOT_KEYS}, {40 * HOT_KEYS})").alias("top")).first()
    heavy = [r["item"] for r in top or () if r["count"] * HOT > n and r["item"] is not None]
    if not heavy:
        return left.join(right, on)
    if keyed:
        among = F.col(on).isin(heavy)
        salted = left.where(among).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        copied = right.where(among).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.where(~among).join(right, on).unionByName(salted.join(copied, [on, "_salt"]).drop("_salt"))
    salt = F.when(F.col(on).isin(heavy), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col(on).isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", copies), [on, "_salt"]).drop("_salt")


# Choice -------------------------------------------------------------------------------------


def _linked(hits: DataFrame, longest: int, chunk: int) -> DataFrame:
    """(row, doc, p, n, key, head, q): the longest hit of each place, whether no earlier hit reaches into it, and the place of the
    first hit behind it, where that is no head. Places are looked at in chunks of a text, with what may matter around them."""
    around = F.expr(f"explode(sequence(greatest(p - {2 * longest}, 0) div {chunk}, (p + {longest}) div {chunk}))")
    dealt = hits.select("*", around.alias("chunk")).repartition("row", "chunk")
    longest_hit = dealt.groupBy("row", "chunk", "p").agg(F.max(F.struct("n", "key", "doc")).alias("h")).select("row", "chunk", "p", "h.*")
    text = Window.partitionBy("row", "chunk")
    reach = F.max(F.col("p") + F.col("n")).over(text.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    headed = longest_hit.withColumn("head", F.coalesce(reach, F.lit(0)) <= F.col("p"))
    # from the end: a hit (1) is seen by whatever ends (0) at its place or before
    events = headed.withColumn("e", F.explode(F.array(F.struct(F.col("p").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("p") + F.col("n")).alias("at"), F.lit(0).alias("kind")))))
    back = text.orderBy(F.desc("e.at"), F.desc("e.kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = F.last(F.when(F.col("e.kind") == 1, F.struct("p", "head")), ignorenulls=True).over(back)
    own = events.withColumn("behind", behind).where((F.col("e.kind") == 0) & F.expr(f"p div {chunk} = chunk"))
    q = F.when(~F.col("behind.head") & (F.col("behind.p") <= F.col("p") + 2 * longest), F.col("behind.p"))
    return own.select("row", "doc", "p", "n", "key", "head", q.alias("q"))


def _followed(one: DataFrame, other: DataFrame) -> DataFrame:
    """Links (row, a, b) of `one`, each followed by the one of `other` that begins where it ends."""
    left, right = one.alias("l"), other.alias("r")
    return left.join(right, (F.col("l.row") == F.col("r.row")) & (F.col("l.b") == F.col("r.a"))).select("l.row", "l.a", "r.b")


def greedy_kept(hits: DataFrame, longest: int, chunk: int = CHUNK, *used: DataFrame) -> DataFrame:
    """Of hits (row, doc, p, n, key), n at most `longest`: those that leftmost-longest matching keeps, (row, doc, p, n, key).
    used: staged tables that only the hits are made from.

    No text is gathered: a chunk of places is the most that meets in a task, and links are followed by joins. Rounds are the
    logarithm of the longest run of kept hits that overlap others all along; most texts need none or one.
    """
    nodes = staged(_linked(hits, longest, chunk), "nodes")
    dropped(*used)
    jumps = nodes.where("q is not null").select("row", F.col("p").alias("a"), F.col("q").alias("b"))
    reached = nodes.where("head and q is not null").select("row", F.col("p").alias("at"))
    parts, last = [], []
    while True:  # each round has links four times as long as the one before
        twice = _followed(jumps, jumps)
        hops = [jumps, twice, _followed(twice, jumps), _followed(twice, twice)]
        hops = staged(reduce(DataFrame.unionByName, [h.withColumn("hops", F.lit(k)) for k, h in enumerate(hops, 1)]), "hops")
        step = reached.join(hops.where("hops < 4"), (reached["row"] == hops["row"]) & (reached["at"] == hops["a"])).select(reached["row"], F.col("b").alias("at"))
        fresh = staged(step.join(reached, ["row", "at"], "left_anti").distinct(), "reached")
        dropped(*last)
        last = [hops]
        parts.append(fresh)
        if fresh.isEmpty():
            dropped(*last)
            break
        reached, jumps = reached.unionByName(fresh), hops.where("hops = 4").drop("hops")
    kept = nodes.where("head")
    if len(parts) > 1:
        more = nodes.where("not head").join(reached.select("row", F.col("at").alias("p")).distinct(), ["row", "p"], "left_semi")
        kept = kept.unionByName(more.select(*kept.columns))
    return kept.select("row", "doc", "p", "n", "key")


def numbered(kept: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """kept with tok_pos: the number of each hit in its text, from counts of the chunks before."""
    k = kept.withColumn("chunk", F.expr(f"p div {chunk}"))
    counts = k.groupBy("row", "chunk").agg(F.count("*").alias("c"))
    before = counts.select("row", "chunk", (F.sum("c").over(Window.partitionBy("row").orderBy("chunk")) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("row", "chunk").orderBy("p"))
    return k.join(before, ["row", "chunk"]).withColumn("tok_pos", F.col("before") + place - 1).drop("chunk", "before")


def _candidates(df: DataFrame, text: Column, ladder: Broadcast, words: int) -> DataFrame:
    """(hi, lo) of spans that may be keys; a task gives each out once for every AT_ONCE spans."""

    def once(found: list[tuple]) -> pa.RecordBatch:
        hi, lo = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        _, first = np.unique(hi ^ (lo << 1), return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first])], names=["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, size = ladder.value, [], 0
        for batch in _sliced(batches, "_t"):
            texts = batch.column("_t").fill_null("").to_pylist()
            for *_, hi, lo in word_probes(texts, known, words) if words else character_probes(texts, known):
                found.append((hi, lo))
                size += len(hi)
            if size >= AT_ONCE:
                yield once(found)
                found, size = [], 0
        if found:
            yield once(found)

    return df.select(text.alias("_t")).mapInArrow(run, "hi long, lo long")


@dataclass
class Verdict:
    """Tells keys from mistakes among spans that may be keys. Filters by turns of mistakes and of keys, each of what the one before
    does not tell apart; rest: rows (hi, lo), sorted, of what the last one lets through of the other kind (without filters: all mistakes)."""

    filters: list[Filter]
    rest: np.ndarray

    def keys(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(hi), dtype=bool), np.arange(len(hi))
        for k, f in enumerate(self.filters):
            inside = f.found(turned(lo[open_], k))
            if k % 2 == 0:  # what is in no filter of mistakes is a key
                out[np.delete(open_, inside)] = True
            open_ = open_[inside]
        out[open_] = _listed(self.rest, hi[open_], lo[open_]) == (len(self.filters) % 2 == 1)
        return out


def _listed(rows: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether (hi, lo) are among sorted rows. First values repeat hardly ever, so few steps find the second."""
    at, out = np.searchsorted(rows[:, 0], hi), np.zeros(len(hi), dtype=bool)
    open_ = np.flatnonzero(at < len(rows))
    while len(open_):
        open_ = open_[rows[at[open_], 0] == hi[open_]]
        out[open_] |= rows[at[open_], 1] == lo[open_]
        at[open_] += 1
        open_ = open_[(at[open_] < len(rows)) & ~out[open_]]
    return out


def _filter_of(prints: DataFrame, n: int, k: int, filter_bytes: int) -> Filter:
    """The filter k of a row of filters, of n prints(hi, lo)."""
    words = Filter.size(n, filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cells(turned(batch.column("lo").to_numpy(), k), words)

    return Filter(_gathered(prints.mapInArrow(run, "cell long, bits long"), words))


def _passing(prints: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(sent.value.found(turned(batch.column("lo").to_numpy(), k))))

    return prints.mapInArrow(run, prints.schema)


def _verdict(df: DataFrame, text: Column, own: DataFrame, ladder: Broadcast, words: int, most: int, filter_bytes: int) -> Verdict | None:
    """None if filters do not leave `most` fingerprints at last: each has to halve what it is held against."""
    keys = own.select("hi", "lo")
    side = staged(_candidates(df, text, ladder, words).distinct().join(keys, ["hi", "lo"], "left_anti"), "mistakes")
    other, made, filters = keys, [side], []
    n, n_other = side.count(), None
    while n > most:
        n_other = own.count() if n_other is None else n_other
        k = len(filters)
        filters.append(_filter_of(side, n, k, filter_bytes))
        sent = df.sparkSession.sparkContext.broadcast(filters[-1])
        rest = staged(_passing(other, sent, k), "undecided")
        sent.unpersist()
        made.append(rest)
        left = rest.count()
        if 2 * left > n_other:
            dropped(*made)
            return None
        side, other, n, n_other = rest, side, left, n
    found = side.toArrow()
    dropped(*made)
    both = np.stack([found.column(c).to_numpy() for c in ("hi", "lo")], axis=1)
    return Verdict(filters, both[np.lexsort((both[:, 1], both[:, 0]))])


def _in_place(df: DataFrame, doc: str, text: Column, ladder: Broadcast, verdict: Broadcast, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, judge, before = ladder.value, verdict.value, TaskContext.get().partitionId() << 40
        for batch in _sliced(batches, "_t"):
            texts = batch.column("_t").fill_null("").to_pylist()
            found = list(word_probes(texts, known, words) if words else character_probes(texts, known))
            if found:
                row, p, n, hi, lo = (np.concatenate([f[k] for f in found]) for k in range(5))
                sure = judge.keys(hi, lo)
                row, p, n = row[sure], p[sure], n[sure]
                order = np.lexsort((-n, p, row))
                place = (row[order] << 40) | p[order]
                order, place = (x[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else x for x in (order, place))
                kept = order[greedy(place, place + n[order])]
                row, p, n = row[kept], p[kept], n[kept]
                split = {r: [w for w in texts[r].split(" ") if w] for r in np.unique(row).tolist()} if words else None
                keys = [JOINER.join(split[r][a : a + k]) if words else texts[r][a : a + k] for r, a, k in zip(row.tolist(), p.tolist(), n.tolist(), strict=True)]
                number = np.arange(len(row)) - np.searchsorted(row, row)
                cols = [pa.array(before + row), batch.column("_d").take(pa.array(row)), pa.array(number), pa.array(p, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc", "tok_pos", "p", "n", "key"])
            before += batch.num_rows

    long = lambda name: T.StructField(name, T.LongType())
    d = df.select(F.col(doc).alias("_d"), text.alias("_t"))
    return d.mapInArrow(run, T.StructType([long("row"), T.StructField("doc", d.schema["_d"].dataType), long("tok_pos"), long("p"), T.StructField("n", T.IntegerType()), T.StructField("key", T.StringType())]))


def longest_matches(df: DataFrame, doc: str, text: Column, keys: DataFrame | Prepared, words: int = 0, filter_bytes: int = FILTER_BYTES, chunk: int = CHUNK, mistakes: int = MISTAKES) -> DataFrame:
    """(row, doc, tok_pos, p, n, key) of leftmost-longest matches of keys(key) in every text of df; row tells the rows of df apart,
    whatever their ids; tok_pos numbers a text's matches. words: as in probes. Null and empty texts, and empty keys, match nothing."""
    ready = keys if isinstance(keys, Prepared) else prepared(staged(with_fingerprints(keys), "keys"), words, filter_bytes)
    own, ladder = ready.own, ready.ladder
    verdict = _verdict(df, text, own, ladder, words, mistakes, filter_bytes)
    if verdict is not None:
        if ready is not keys:
            dropped(own)
        return staged(_in_place(df, doc, text, ladder, df.sparkSession.sparkContext.broadcast(verdict), words), "matches")
    found = staged(probes(df, doc, text, ladder, words), "probes")
    hits = hot_join(found, "hi", own.withColumnRenamed("lo", "lo_"), ["row", "p"]).where("lo = lo_").select("row", "doc", "p", "n", "key")
    used = (found,) if ready is keys else (found, own)
    return numbered(greedy_kept(hits, words or ready.longest, chunk, *used), chunk).select("row", "doc", "tok_pos", "p", "n", "key")
