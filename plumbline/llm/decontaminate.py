"""Benchmark decontamination by winnowing.

Every text keeps, for each window of ``window`` neighbouring k-grams of words, the
one with the smallest hash. Fingerprints of documents and benchmark items are
joined and each hit is extended word by word in both directions. Two texts that
share a span of ``k + window - 1`` words share a whole window, therefore its
smallest k-gram: every shared span of at least that many words is found, and the
result is exactly the set of maximal shared spans of ``min_words`` words or more.

Defined results: a null or empty text has no words and no hits; an item of fewer
than ``min_words`` words can't be hit; repeated documents and items are each
reported under their own id (rows of equal id and text give equal rows); a null
id stays null; columns other than the id and the text are ignored. What ``decontaminate``
takes out is decided row by row, by the text: rows without an id, or that share one, as
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, match_rows, pick, rows_binary, ship, text_hash
from .textops import U, Words, buffers, grams, ranges, text_chunks, winnow, words

K, WINDOW = 8, 6
MIN_WORDS = K + WINDOW - 1
#: Benchmark words (8 bytes each, and 16 for a fingerprint) up to which the benchmark is sent to every executor.
BROADCAST_WORDS = 4_000_000

HITS = "doc_id long, item_id long, doc_start int, item_start int, n_words int"


def fingerprints(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chosen places (indexes into w.hash) and their k-gram hashes."""
    g, lo, hi = grams(w, k)
    _, at = winnow(g, lo, hi, window)
    at = np.unique(at)
    return at, g[at]


def extend(dh, d_lo, d_hi, bh, b_lo, b_hi, d, b, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow hits (places d and b with k equal words) to maximal spans: starts in both, and words."""
    d0, b0, d1, b1 = d.copy(), b.copy(), d + k, b + k
    live = np.flatnonzero((d0 > d_lo) & (b0 > b_lo))
    while len(live):
        live = live[dh[d0[live] - 1] == bh[b0[live] - 1]]
        d0[live] -= 1
        b0[live] -= 1
        live = live[(d0[live] > d_lo[live]) & (b0[live] > b_lo[live])]
    live = np.flatnonzero((d1 < d_hi) & (b1 < b_hi))
    while len(live):
        live = live[dh[d1[live]] == bh[b1[live]]]
        d1[live] += 1
        b1[live] += 1
        live = live[(d1[live] < d_hi[live]) & (b1[live] < b_hi[live])]
    return d0, b0, d1 - d0


class Bench:
    """A benchmark in memory: words of all items side by side, and sorted fingerprints."""

    def __init__(self, ids: list, hashes: np.ndarray, n: np.ndarray, k: int, window: int):
        self.ids = ids
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.hash = hashes
        at, g = fingerprints(Words(hashes, None, None, self.first), k, window)
        order = np.argsort(g, kind="stable")
        self.gram, self.at = g[order], at[order]
        self.item = np.searchsorted(self.first, self.at, side="right") - 1

    def hits(self, w: Words, k: int, window: int, least: int) -> tuple[np.ndarray, ...]:
        """document index, item index, starts within them, words."""
        at, g = fingerprints(w, k, window)
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        found = hi > lo
        at, lo, hi = at[found], lo[found], hi[found]
        j = ranges(lo, hi)
        d, b, item = np.repeat(at, hi - lo), self.at[j], self.item[j]
        doc = np.searchsorted(w.first, d, side="right") - 1
        d0, b0, n = extend(w.hash, w.first[doc], w.first[doc + 1], self.hash, self.first[item], self.first[item + 1], d, b, k)
        rows = np.stack([doc, item, d0 - w.first[doc], b0 - self.first[item], n], 1)[n >= least]
        rows = np.unique(rows, axis=0) if len(rows) else rows
        return tuple(rows.T) if len(rows) else tuple(np.zeros(0, np.int64) for _ in range(5))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text"):
        w = words(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), binary_rows(w.hash, np.diff(w.first))], ["item_id", "words"])


def _held(spark: SparkSession, benchmark: DataFrame, k: int, window: int, broadcast_words: int) -> tuple[DataFrame, Broadcast | None]:
    """The words of each item, and the benchmark on every executor where it has at most ``broadcast_words``."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    item_words = Scratch(spark, "decontaminate").write(items.mapInArrow(_item_words, "item_id long, words binary"), "items")
    size = item_words.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    if size > broadcast_words:
        return item_words, None
    got = item_words.toArrow()
    hashes, n = rows_binary(got.column("words"), U)
    return item_words, spark.sparkContext.broadcast(Bench(got.column("item_id").to_pylist(), hashes, n, k, window))


def _narrow(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Maximal word spans that documents share with benchmark items (see the module).

    The benchmark's size is counted first: up to ``broadcast_words`` it goes to
    every executor and documents aren't shuffled at all; beyond that fingerprints
    are joined by a shuffle, with the same result.
    """
    if min_words < k + window - 1:
        raise ValueError("spans shorter than k + window - 1 words can't be guaranteed")
    item_words, bench = _held(docs.sparkSession, benchmark, k, window, broadcast_words)
    if bench is None:
        return _by_shuffle(_narrow(docs), item_words, k, window, min_words).drop("th").dropDuplicates()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bench.value
        ids = pa.array(held.ids, pa.int64())
        for batch in text_chunks(batches, "text"):
            doc, item, d, b, n = held.hits(words(*buffers(batch.column("text"))), k, window, min_words)
            if len(doc):
                small = [pa.array(x.astype(np.int32)) for x in (d, b, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), ids.take(pa.array(item)), *small], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    return _narrow(docs).mapInArrow(scan, HITS).dropDuplicates()


def _by_shuffle(docs: DataFrame, item_words: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """The hits, with the hash of the text (th) that has them."""
    docs = docs.withColumn("th", text_hash(docs))

    def marks(ids: list[str], from_words: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if from_words else text_chunks(batches, "text"):
                if from_words:
                    h, n = rows_binary(batch.column("words"), U)
                    w = Words(h, None, None, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
                else:
                    w = words(*buffers(batch.column("text")))
                at, g = fingerprints(w, k, window)
                row = pa.array(np.searchsorted(w.first, at, side="right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *(batch.column(i).take(row) for i in ids)], ["gram", *ids])

        return run

    left = docs.mapInArrow(marks(["doc_id", "th"], False), "gram long, doc_id long, th long")
    right = item_words.mapInArrow(marks(["item_id"], True), "gram long, item_id long")
    pairs = left.join(right.distinct(), "gram").select("doc_id", "th", "item_id").distinct()
    both = docs.join(pairs, docs.doc_id.eqNullSafe(pairs.doc_id) & (docs.th == pairs.th)).select(docs.doc_id, docs.th, "text", "item_id")
    both = both.join(item_words, both.item_id.eqNullSafe(item_words.item_id)).select("doc_id", "th", "text", both.item_id, "words")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                h, n = rows_binary(one.column("words"), U)
                _, _, d, b, m = Bench([None], h, n, k, window).hits(words(*buffers(one.column("text"))), k, window, least)
                if len(d):
                    zero = pa.array(np.zeros(len(d), np.int64))
                    yield pa.RecordBatch.from_arrays([*(one.column(c).take(zero) for c in ("doc_id", "item_id")), *(pa.array(x.astype(np.int32)) for x in (d, b, m)), one.column("th").take(zero)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "th"])

    return both.mapInArrow(grow, f"{HITS}, th long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Documents, with all their columns, that share no span of ``min_words`` words or more with the benchmark."""
    if min_words < k + window - 1:
        raise ValueError("spans shorter than k + window - 1 words can't be guaranteed")
    ship(docs.sparkSession)
    item_words, bench = _held(docs.sparkSession, benchmark, k, window, broadcast_words)
    if bench is None:
        gone = _by_shuffle(_narrow(docs), item_words, k, window, min_words).select("doc_id", "th").distinct()
        return match_rows(docs, gone, "left_anti")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            doc = bench.value.hits(words(*buffers(batch.column("text"))), k, window, min_words)[0]
            kept = np.ones(batch.num_rows, bool)
            kept[doc] = False
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(clean, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH dw AS (SELECT doc_id, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter({_SPLIT}, lambda x: x <> '') AS w FROM benchmark),
bg AS (SELECT item_id, w, unnest(range(1, len(w) - {MIN_WORDS} + 2)) AS p FROM bw WHERE len(w) >= {MIN_WORDS}),
b AS (SELECT item_id, p, array_to_string(w[p:p + {MIN_WORDS} - 1], ' ') AS g FROM bg),
dg AS (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS} + 2)) AS p FROM dw WHERE len(w) >= {MIN_WORDS}),
d AS (SELECT doc_id, p, array_to_string(w[p:p + {MIN_WORDS} - 1], ' ') AS g FROM dg),
h AS (SELECT doc_id, item_id, d.p AS dp, b.p AS bp FROM d JOIN b USING (g)),
i AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY dp) AS island FROM h)
SELECT doc_id, item_id, CAST(min(dp) - 1 AS INTEGER) AS doc_start, CAST(min(bp) - 1 AS INTEGER) AS item_start,
  CAST(count(*) + {MIN_WORDS} - 1 AS INTEGER) AS n_words
FROM i GROUP BY doc_id, item_id, dp - bp, island
"""
