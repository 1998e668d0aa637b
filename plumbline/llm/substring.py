"""Substring dedup by level-wise doubling: passages of 50 words or more that occur twice.

Level 0 looks at windows of ``BASE`` = 25 words. Only anchors are counted: of every 26
neighbouring windows the one with the smallest hash, so each passage of 50 words holds
the anchors that the same passage has elsewhere. Anchors that occur once are dropped
before anything is carried: executors test anchors against a bitmap of the repeated
ones, or, where these are too many for one, rows of bare anchors are joined with them.

Level 1 extends the rest to 50 words: every 50-word window has one anchor (the
smallest of its 26), so windows are counted next to their anchor: a repeated anchor's
row carries the hashes of its windows, and rows meet in one shuffle by the anchor's
hash. All 50-word windows at all positions that occur more than once are found, none
else.

Level k + 1 joins two windows of level k that follow each other to one of twice the
length, at all positions, until none is left. These are counted like those of level 1, next to the
anchor of their first 50 words. What is left of each document is stitched to spans.

Result: (doc_id, start, end, words, longest, later). A span is a maximal run of words
[start, end) covered by repeated 50-word windows; ``longest`` is the greatest length
25 * 2^k at which a window in it still repeats; ``later`` is the number of its words
covered by windows that occur earlier too (smaller doc_id, or further left in the same text): what
deduplication would remove.

Defined results: null and empty texts and those of fewer than 50 words have no spans;
a passage repeated within one text counts; repeated rows of an id are one document and
don't repeat each other (rows of one id with different texts aren't told apart:
their windows count once per position); rows without an id are left out; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, clustered, column_to_numpy, pick, rows_binary, text_hash, whole_groups
from .textops import U, Words, buffers, mix, ranges, span_hash, text_chunks, winnow, words

BASE = 25
LENGTH = 2 * BASE
#: Occurrences of an anchor up to which one task looks at all of them; those of more frequent
#: anchors are counted window by window, which combines before the shuffle.
HOT = 200_000
#: Repeated anchors (2 to 4 bytes each in the bitmap) up to which they are sent to every executor.
FILTER_ANCHORS = 1 << 25
_CHUNK = 19  # bits of a place in a piece of the bitmap
ANCHORS = "anchor long, doc_id long, place int, first int, windows binary"
LEVEL1 = "doc_id long, anchor long, place int, at binary, later binary, window binary"
STITCHED = "doc_id long, start int, end int, later int, length int, meet long, windows binary"
SPANS = "doc_id long, start int, end int, words int, longest int, later int"


def _anchored(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: hash, document, place, first window, and how many windows each has; places count from the first document."""
    g = span_hash(w.hash, BASE)
    lo, hi = w.first[:-1], w.first[1:] - BASE + 1
    long_ = w.first[1:] - lo >= LENGTH
    start, at = winnow(g, lo[long_], hi[long_], LENGTH - BASE + 1)
    if not len(start):
        return np.zeros(0, U), start, start, start, start
    order = np.argsort(start, kind="stable")
    start, at = start[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    n = np.diff(np.append(new, len(start)))
    return g[at[new]], np.searchsorted(w.first, start[new], side="right") - 1, at[new], start[new], n


def _anchors(keep: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]):
    """A row per kept anchor: its hash, document and place, the first window it belongs to, and the hashes of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            w = words(*buffers(batch.column("text")))
            anchor, doc, place, first, n = _anchored(w)
            kept = keep(batch, anchor, doc)
            anchor, doc, place, first, n = (x[kept] for x in (anchor, doc, place, first, n))
            if not len(anchor):
                continue
            base = w.first[doc]
            whole = span_hash(w.hash, LENGTH)[ranges(first, first + n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), pa.array((place - base).astype(np.int32)), pa.array((first - base).astype(np.int32)), binary_rows(whole, n)],
                ["anchor", "doc_id", "place", "first", "windows"],
            )

    return run


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors alone, with whatever columns there are besides the text."""
    for batch in text_chunks(batches, "text"):
        anchor, doc, *_ = _anchored(words(*buffers(batch.column("text"))))
        other = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *(batch.column(c).take(pa.array(doc)) for c in other)], ["anchor", *other])


def _bitmap(twice: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """One bit for the first so many bits of each anchor: 16 places or more for one that is set."""
    bits = max(_CHUNK, int(np.ceil(np.log2(16 * max(1, n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "chunk"):
            chunk = column_to_numpy(table, "chunk")
            at = (column_to_numpy(table, "anchor").view(U) >> U(64 - bits)).astype(np.int64)
            for c in np.unique(chunk):
                own = np.zeros(1 << _CHUNK, bool)
                own[at[chunk == c] & ((1 << _CHUNK) - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    chunk = F.lit(0).cast("long") if bits == _CHUNK else F.shiftrightunsigned("anchor", 64 - bits + _CHUNK)
    got = clustered(twice.select("anchor", chunk.alias("chunk")), "chunk").mapInArrow(run, "chunk long, bits binary").toArrow()
    out = np.zeros((1 << (bits - _CHUNK), 1 << (_CHUNK - 3)), np.uint8)
    for c, b in zip(got.column("chunk").to_pylist(), got.column("bits"), strict=True):
        out[c] = np.frombuffer(b.as_buffer(), np.uint8)
    return out.ravel(), bits


def _repeated_anchors(docs: DataFrame, twice: DataFrame, filter_anchors: int) -> DataFrame:
    """Rows of ``_anchors`` for the anchors of ``twice``, and perhaps some others."""
    n = twice.count()
    if n <= filter_anchors:
        held = docs.sparkSession.sparkContext.broadcast(_bitmap(twice, n))

        def keep(batch: pa.RecordBatch, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
            bitmap, bits = held.value
            at = anchor >> U(64 - bits)
            return (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0

        return docs.mapInArrow(_anchors(keep), ANCHORS)
    docs = docs.withColumn("th", text_hash(docs))
    wanted = docs.mapInArrow(_bare, "anchor long, doc_id long, th long").join(twice, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("wanted"))

    def listed(batch: pa.RecordBatch, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
        lists = batch.column("wanted")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        salt = lambda h, r: h ^ mix(r.astype(U) + U(1))
        return np.isin(salt(anchor, doc), salt(lists.flatten().to_numpy().view(U), row))

    return docs.join(wanted, ["doc_id", "th"]).mapInArrow(_anchors(listed), ANCHORS)


def _windows(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of all 50-word windows of anchor rows."""
    first = column_to_numpy(table, "first")
    window, n = rows_binary(table.column("windows"), U)
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row].astype(np.int64) + ranges(np.zeros(len(n), np.int64), n), window


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window."""
    for batch in batches:
        if batch.num_rows:
            row, at, window = _windows(batch)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), *(batch.column(c).take(take) for c in ("doc_id", "anchor", "place")), pa.array(at.astype(np.int32))],
                ["window", "doc_id", "anchor", "place", "at"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one repeated window each, in the form of ``_repeated``."""
    for batch in batches:
        one = np.ones(batch.num_rows, np.int64)
        at, later, window = (column_to_numpy(batch, c) for c in ("at", "later", "window"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "anchor", "place")), binary_rows(at.astype(np.int32), one), binary_rows(later.astype(np.uint8), one), binary_rows(window.astype(np.int64), one)],
            ["doc_id", "anchor", "place", "at", "later", "window"],
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows side by side by anchor: the windows that occur more than once, and which of them occur earlier too."""
    for table in whole_groups(batches, "anchor"):
        doc, anchor, place, first = (column_to_numpy(table, c) for c in ("doc_id", "anchor", "place", "first"))
        row, at, window = _windows(table)
        order = np.lexsort((at, doc[row], window))
        win, d, p = window[order], doc[row][order], at[order]
        fresh = np.concatenate([[True], (win[1:] != win[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])])  # not again for repeated rows
        order, win = order[fresh], win[fresh]
        head = np.concatenate([[True], win[1:] != win[:-1]])
        begins = np.flatnonzero(head)
        size = np.diff(np.append(begins, len(win)))
        twice = np.repeat(size > 1, size)
        order, later = order[twice], ~head[twice]
        win = win[twice]
        if not len(order):
            continue
        by_row = np.argsort(row[order] * np.int64(LENGTH) + (at[order] - first[row[order]]), kind="stable")
        order, later, win = order[by_row], later[by_row], win[by_row]
        r = row[order]
        new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        size = np.diff(np.append(new, len(r)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[r[new]]),
                pa.array(anchor[r[new]]),
                pa.array(place[r[new]]),
                binary_rows(at[order].astype(np.int32), size),
                binary_rows(later.astype(np.uint8), size),
                binary_rows(win, size),
            ],
            ["doc_id", "anchor", "place", "at", "later", "window"],
        )


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its spans, and next to each anchor all windows of 100, 200, ... words whose parts of 50 words all repeat."""
    for table in whole_groups(batches, "doc_id"):
        doc = column_to_numpy(table, "doc_id")
        at, n = rows_binary(table.column("at"), np.int32)
        later = rows_binary(table.column("later"), np.uint8)[0].astype(bool)
        win = rows_binary(table.column("window"), U)[0]
        d = np.repeat(doc, n)
        place, anchor = (np.repeat(column_to_numpy(table, c), n) for c in ("place", "anchor"))
        order = np.lexsort((at, d))
        d, at, later, win, place, anchor = d[order], at[order].astype(np.int64), later[order], win[order], place[order], anchor[order]
        cut = np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] > at[:-1] + LENGTH)])
        begin = np.flatnonzero(cut)
        span = np.cumsum(cut) - 1
        start, end = at[begin], np.maximum.reduceat(at, begin) + LENGTH
        # words covered by windows that occur earlier
        reach = np.zeros(len(begin), np.int64)
        i = np.flatnonzero(later)
        if len(i):
            gap = np.minimum(np.diff(at[i], append=0), LENGTH)
            last = np.append((span[i][1:] != span[i][:-1]), True)
            gap[last] = LENGTH
            np.add.at(reach, span[i], gap)
        # windows of twice the length, from two that follow each other
        with np.errstate(over="ignore"):
            key = mix(d.view(U) if d.dtype == np.int64 else d.astype(U)) + at.astype(U)
        rank = np.argsort(key, kind="stable")
        sorted_key = key[rank]
        none = pa.nulls(len(begin), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[begin]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(reach.astype(np.int32)), none, none.cast(pa.int64()), none.cast(pa.string()).cast(pa.binary())],
            ["doc_id", "start", "end", "later", "length", "meet", "windows"],
        )
        here, length = np.arange(len(at)), LENGTH
        value = win.copy()
        alive = np.ones(len(at), bool)
        while True:
            with np.errstate(over="ignore"):
                want = key[here] + U(length)
            j = np.minimum(np.searchsorted(sorted_key, want), len(key) - 1)
            follows = rank[j]
            ok = (sorted_key[j] == want) & (d[follows] == d[here]) & (at[follows] == at[here] + length) & alive[follows]
            here, follows = here[ok], follows[ok]
            if not len(here):
                break
            with np.errstate(over="ignore"):
                hashes = mix(value[here] * U(0xD6E8FEB86659FD93) + value[follows] + U(length))
            length *= 2
            alive[:] = False
            alive[here] = True
            value[here] = hashes
            new = np.flatnonzero(np.concatenate([[True], (d[here][1:] != d[here][:-1]) | (span[here][1:] != span[here][:-1]) | (place[here][1:] != place[here][:-1])]))
            size, one = np.diff(np.append(new, len(here))), here[new]
            none = pa.nulls(len(new), pa.int32())
            with np.errstate(over="ignore"):
                meet = mix(anchor[one].view(U) + U(length))  # a level's windows meet apart from the others
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[one]), pa.array(start[span[one]].astype(np.int32)), none, none, pa.array(np.full(len(new), length, np.int32)), pa.array(meet.view(np.int64)), binary_rows(hashes, size)],
                ["doc_id", "start", "end", "later", "length", "meet", "windows"],
            )


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows side by side by meeting place: those with a window that occurs more than once."""
    for table in whole_groups(batches, "meet"):
        win, n = rows_binary(table.column("windows"), U)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(win, kind="stable")
        same = win[order][1:] == win[order][:-1]
        hit = np.unique(row[order][np.concatenate([[False], same]) | np.concatenate([same, [False]])])
        if len(hit):
            yield from table.select(["doc_id", "start", "length"]).take(pa.array(hit)).combine_chunks().to_batches()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per longer window."""
    for batch in batches:
        win, n = rows_binary(batch.column("windows"), np.int64)
        take = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([pa.array(win), *(batch.column(c).take(take) for c in ("doc_id", "start", "length"))], ["window", "doc_id", "start", "length"])


def _hot_windows(rows: DataFrame) -> DataFrame:
    """What ``_repeated`` finds, for anchors of which one task can't hold all occurrences."""
    each = rows.mapInArrow(_spread, "window long, doc_id long, anchor long, place int, at int").distinct()
    twice = each.groupBy("window").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "at")).alias("least")).filter("m > 1").select("window", "least")
    hit = each.join(twice, "window").select("doc_id", "anchor", "place", "at", (F.struct("doc_id", "at") != F.col("least")).alias("later"), "window")
    return hit.mapInArrow(_packed, LEVEL1)


def repeats(docs: DataFrame, hot: int = HOT, filter_anchors: int = FILTER_ANCHORS) -> DataFrame:
    """Maximal repeated spans of each document (see the module).

    Anchors are counted first, in a pass of its own. Those that occur more than ``hot``
    times take another way to the same result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    twice = scratch.write(docs.select("text").mapInArrow(_bare, "anchor long").groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "twice")
    anchors = _repeated_anchors(docs, twice.select("anchor"), filter_anchors)
    frequent = scratch.write(twice.filter(F.col("m") > hot).select("anchor"), "hot")
    if frequent.isEmpty():
        found = clustered(anchors, "anchor").mapInArrow(_repeated, LEVEL1)
    else:  # there are at most (anchors / hot) of them
        cold = anchors.join(frequent, "anchor", "left_anti")
        found = clustered(cold, "anchor").mapInArrow(_repeated, LEVEL1).unionByName(_hot_windows(anchors.join(frequent, "anchor", "left_semi")))
    level1 = scratch.write(found, "windows")
    found = scratch.write(clustered(level1, "doc_id").mapInArrow(_stitch, STITCHED), "stitched")
    scratch.drop("windows")
    scratch.drop("twice")
    spans = found.filter("length IS NULL").select("doc_id", "start", "end", "later")
    longer = found.filter("length IS NOT NULL").select("doc_id", "start", "length", "meet", "windows")
    kind = "doc_id long, start int, length int"
    crowds = scratch.write(longer.groupBy("meet").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("meet"), "crowds")
    if crowds.isEmpty():
        again = clustered(longer, "meet").mapInArrow(_again, kind)
    else:
        each = longer.join(crowds, "meet", "left_semi").mapInArrow(_each, f"window long, {kind}")
        twice = each.groupBy("window").agg(F.count("*").alias("m")).filter("m > 1").select("window")
        again = clustered(longer.join(crowds, "meet", "left_anti"), "meet").mapInArrow(_again, kind).unionByName(each.join(twice, "window").select("doc_id", "start", "length"))
    top = again.groupBy("doc_id", "start").agg(F.max("length").alias("top"))
    spans = spans.join(top, ["doc_id", "start"], "left")
    best = F.coalesce("top", F.lit(LENGTH).cast("int"))
    return spans.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("words"), best.alias("longest"), "later")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
