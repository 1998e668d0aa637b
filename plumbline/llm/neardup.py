"""N-gram Jaccard self-join with signature trees.

A document is the set of hashes of its word trigrams (a shorter text is one gram).
Its signature is a bitmap of ``BITS`` bits, one set per gram, with its size. In a
tree, a node holds the OR of the bitmaps below it, their range of sizes and the
largest *excess* (grams less bits set). Of two nodes, the overlap of any two
documents below is at most

    min(largest sizes, bits common to both + smaller excess)

and must be at least t / (1 + t) of the sum of the smallest sizes; a dual traversal
from the roots drops node pairs that can't reach it, and pairs whose sizes differ
too much. What arrives at the leaves is verified against the whole gram sets.

The join is exact: no pair of different sets that meets the threshold is left out.

1. Each set gets a label: of the sets that are the least of those with one of its
   ``BANDS`` keys (two min-hashes each), the one it shares most keys with, two at
   least; otherwise its own name. Labels only say where a pair is compared.
2. Sets of one label are all compared, by a tree of them. A label of more than
   ``TILE`` grams is cut into parts by a hash of the name, and each two parts are
   compared in a place of their own, so that no task holds more than two.
3. Sets of different labels meet by prefixes: grams are ordered by how often a sample
   has them, then by hash, and of a set of n the first n - ceil(t n) + 1 are posted. Two
   sets that meet the threshold share at least ``_needs`` of these, in places that
   their sizes bound; pairs that do are verified. The sample decides only how
   many pairs are looked at: any order gives the same result.

Documents with equal gram sets are one up to the end. Jaccard is that of whole sets
of 64-bit gram hashes; a set is named by a 64-bit hash of it, a text by one as well.

``linked``: (doc_id, class_id, links), a row per document: the smallest id of all
documents that it is connected with, and how many others have a Jaccard of at least
t with it, copies included. Rows are told apart by id and text, and a repeated row counts once;
documents without words are in a class of their own; rows without an id are left out.

``similar_pairs``: (doc_a, doc_b, jaccard), doc_a < doc_b: every verified pair of distinct gram
sets, each set named by its smallest id, and (smallest id, copy, 1.0) for each other
document of a set. So groups of n exact copies are n - 1 rows, not n(n-1)/2.

Defined results there: null and empty texts, and those without words, are in no pair; rows
without an id can't be named in pairs and are left out there;
repeated rows of one id are one document; of an id whose rows differ in text the most
similar text counts, and it isn't paired with itself; other columns are ignored.

``deduplicated`` decides row by row: rows are told apart by id and text, and one row of each
group stays: that of the smallest id (rows without an id come last, ties go by the
hash of the text), once where it is repeated (then the row with the smallest hash of all
columns). Rows without words stay. Columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, clustered, column_to_numpy, match_rows, pick, rows_binary, text_hash, whole_groups
from .textops import U, buffers, grams, mix, ranges, span_of, text_chunks, words

N, THRESHOLD, BANDS, ROWS, BITS = 3, 0.5, 16, 2, 2048
LEAF, FAN, FRONTIER = 16, 8, 1 << 15
#: Sets whose grams are counted to order all grams, grams a part and a tile, pairs and bytes held at a time, and pairs up to which bitmaps don't pay: none changes a result.
SAMPLE, PART, TILE, MEETINGS, MAP_BYTES, CHUNK, FEW = 16_000, 1 << 23, 1 << 20, 1 << 19, 1 << 25, 1 << 22, 64
#: Rows up to which labels, and the ids of the texts to verify, are broadcast to be joined with texts; beyond that the texts are shuffled.
BROADCAST_IDS = 2_000_000

_SEEDS = [U(x | 1) for x in np.random.default_rng(77).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(U)]


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each document side by side (sorted within it), and how many each has."""
    w = words(raw, offsets)
    g, lo, hi = grams(w, n)
    per = np.diff(w.first)
    at = ranges(lo, hi)
    doc = np.repeat(np.arange(w.n_docs), np.maximum(hi - lo, 0))
    h = g[at]
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        h = np.concatenate([h, np.array([span_of(w.hash[w.first[i] : w.first[i + 1]]) for i in short], U)])
        doc = np.concatenate([doc, short])
    n_docs = w.n_docs
    del w, g, at  # else they are held beside what sorting takes
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=n_docs)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each text's gram set, its size and its band keys; a text without words has size 0 and no keys."""
    for batch in text_chunks(batches, "text"):
        h, n = gram_sets(*buffers(batch.column("text")))
        some = np.flatnonzero(n)
        one, two = np.zeros(len(n), U), np.zeros(len(n), U)
        band = np.zeros((0, BANDS), U)
        if len(some):
            cuts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            with np.errstate(over="ignore"):
                minima = np.stack([np.minimum.reduceat(mix(h * s), cuts) for s in _SEEDS], 1).reshape(len(some), BANDS, ROWS)
                band = np.arange(BANDS, dtype=U) + U(1)
                for r in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + minima[:, :, r])
                one[some], two[some] = np.add.reduceat(mix(h + U(1)), cuts), np.bitwise_xor.reduceat(mix(h + U(2)), cuts)
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(np.where(n > 0, BANDS, 0), out=ends[1:])
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int32)), keys],
            ["doc_id", "th", "name", "two", "n", "keys"],
        )


def _fits(common: np.ndarray, lo_a, hi_a, ex_a, lo_b, hi_b, ex_b, t: float) -> np.ndarray:
    """Whether some pair below two nodes can reach the threshold."""
    most = np.minimum(np.minimum(hi_a, hi_b), common + np.minimum(ex_a, ex_b))
    return (most >= t / (1 + t) * (lo_a + lo_b) - 1e-9) & (np.minimum(hi_a, hi_b) >= t * np.maximum(lo_a, lo_b) - 1e-9)


class Tree:
    """Nodes of each level from the documents (level 0) up to one root."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, fan: int = FAN):
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, n, n, excess)]
        self.fan = fan
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def test(self, level: int, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        b, lo, hi, ex = self.levels[level]
        common = np.bitwise_count(b[i] & b[j]).sum(1, dtype=np.int64)
        return _fits(common, lo[i], hi[i], ex[i], lo[j], hi[j], ex[j], t)

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents (i < j) that the bounds admit, some at a time."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONTIER:
                stack += [(level, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
                continue
            if level == 0:
                i, j = i[i < j], j[i < j]
            ok = self.test(level, i, j, t)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            below = len(self.levels[level - 1][1])
            c = i[:, None] * self.fan + np.arange(self.fan)
            d = j[:, None] * self.fan + np.arange(self.fan)
            c, d = np.repeat(c, self.fan, 1).ravel(), np.tile(d, (1, self.fan)).ravel()
            fine = (c < below) & (d < below) & (c <= d)
            stack.append((level - 1, c[fine], d[fine]))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set, the least name among those that share a band key with it, once a key."""
    for table in whole_groups(batches, "key"):
        key, name = column_to_numpy(table, "key"), column_to_numpy(table, "name")
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = np.repeat(np.minimum.reduceat(name, starts), np.diff(np.append(starts, len(key))))
        at = np.flatnonzero(lead != name)
        yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(lead[at])], ["name", "label"])


def _gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram hashes of some texts, by their first four bits."""
    for batch in text_chunks(batches, "text", CHUNK):
        h = np.sort(gram_sets(*buffers(batch.column("text")))[0])
        ends = np.searchsorted(h, np.arange(1, 16, dtype=U) << U(60))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16, dtype=np.int32)), binary_rows(h, np.diff(np.concatenate([[0], ends, [len(h)]])))], ["part", "grams"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "part"):
        h, m = np.unique(rows_binary(table.column("grams"), U)[0], return_counts=True)
        h, m = h[m > 1], m[m > 1]
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([m.astype(np.int32).tobytes()], pa.binary())], ["grams", "m"])


def _frequencies(docs: DataFrame, sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams that a sample of about SAMPLE sets repeats, sorted, and in how many of these sets each is: this only orders grams."""
    some = sets.filter(F.pmod(F.xxhash64("name"), F.lit(max(total, 1))) < SAMPLE).select(F.col("row.doc_id").alias("i"), F.col("row.th").alias("t"))
    texts = docs.join(F.broadcast(some), docs["doc_id"].eqNullSafe(some["i"]) & (docs["th"] == some["t"])).dropDuplicates(["doc_id", "th"]).select("text")
    rows = clustered(texts.mapInArrow(_gram_blocks, "part int, grams binary"), "part").mapInArrow(_repeated, "grams binary, m binary").collect()
    h, m = np.frombuffer(b"".join(r.grams for r in rows), U), np.frombuffer(b"".join(r.m for r in rows), np.int32)
    order = np.argsort(h)
    return h[order], m[order]


def _at_least(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _postings(t: float, bits: int, frequent):
    """The rarest grams of each text, up to the one that two texts that meet the threshold must share by; 2^bits parts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        for batch in text_chunks(batches, "text", CHUNK):
            h, n = gram_sets(*buffers(batch.column("text")))
            if not len(h):
                continue
            some = np.flatnonzero(n)
            cuts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            name = np.zeros(len(n), np.int64)
            with np.errstate(over="ignore"):
                name[some] = np.add.reduceat(mix(h + U(1)), cuts).view(np.int64)
            label = batch.column("label")
            label = np.where(label.is_null().to_numpy(zero_copy_only=False), name, label.fill_null(0).to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, often[at], 0).astype(np.int64)
            order = np.argsort(doc << 32 | rank, kind="stable")
            place = np.arange(len(h)) - np.repeat(cuts, n[some])
            keep = place < (n - _at_least(t * n) + 1)[doc]
            order, doc, place = order[keep], doc[keep], place[keep]
            h = h[order]
            part = (h & U((1 << bits) - 1)).astype(np.int64)  # grams are ordered by their high bits, so that low ones spread what is posted
            q = (place * 256 // n[doc]).astype(np.uint8)
            order = np.argsort(part * len(n) + doc, kind="stable")
            part, doc, q, rest = part[order], doc[order], q[order], (h[order] >> U(bits) & U(0xFFFFFFFF)).astype(np.uint32)
            begins = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
            count = np.diff(np.append(begins, len(doc)))
            d = doc[begins]
            table = np.stack([name[d], label[d], n[d].astype(np.int64) << 32 | count], 1)
            parts, rows, grams = np.unique(part), np.bincount(part[begins]), np.bincount(part)
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), binary_rows(table.ravel(), rows[parts] * 3), binary_rows(rest, grams[parts]), binary_rows(q, grams[parts])], ["part", "sets", "grams", "places"])

    return run


def _needs(na: np.ndarray, nb: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The least overlap of two sets that meet the threshold, and how many of it are among the posted grams of both."""
    overlap = _at_least(t / (1 + t) * (na + nb))
    return overlap, np.maximum(1, overlap - _at_least(t * np.maximum(na, nb)) + 1)


def _meetings(t: float):
    """Sets of different labels that share posted grams, and how many in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            sets = rows_binary(table.column("sets"), np.int64)[0].reshape(-1, 3)
            grams, places = rows_binary(table.column("grams"), np.uint32)[0], rows_binary(table.column("places"), np.uint8)[0]
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), sets[:, 2] & 0xFFFFFFFF)
            order = np.argsort(grams, kind="stable")
            g = grams[order]
            again = np.zeros(len(g), np.bool_)
            again[1:] = g[1:] == g[:-1]
            again[:-1] |= again[1:]
            order = order[again]
            g, owner, places = grams[order], owner[order], places[order]
            names, of = np.unique(sets[:, 0], return_inverse=True)
            of, label, n = of[owner], sets[owner, 1], sets[owner, 2] >> 32
            order = np.lexsort((of, label, g))
            g, of, label, n, places = g[order], of[order], label[order], n[order], places[order]
            if not len(g):
                continue
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (of[1:] != of[:-1])])  # a text and its copies are one set
            g, of, label, n, places = g[new], of[new], label[new], n[new], places[new]
            ends = np.flatnonzero(np.concatenate([g[1:] != g[:-1], [True]])) + 1
            end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
            stops = np.flatnonzero(np.concatenate([(g[1:] != g[:-1]) | (label[1:] != label[:-1]), [True]])) + 1
            begin = np.repeat(stops, np.diff(np.concatenate([[0], stops])))
            sure = places.astype(np.int64) * n // 256  # the place of a gram in its set, or less
            size, labels = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            size[of], labels[of] = n, label
            total = np.concatenate([[0], np.cumsum(end - begin)])
            held, pairs, at = [], 0, 0

            def merged(held):
                code, count = np.concatenate([c for c, _ in held]), np.concatenate([k for _, k in held])
                order = np.argsort(code, kind="stable")
                code, count = code[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                return code[first], np.add.reduceat(count, first)

            def batch(held, names=names, size=size, labels=labels):
                code, count = merged(held)
                for k in range(0, len(code), FRONTIER * 8):
                    a, b = np.divmod(code[k : k + FRONTIER * 8], len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[a], names[b], size[a], size[b], count[k : k + FRONTIER * 8])], ["a", "b", "na", "nb", "m"])

            while at < len(g):
                to = max(at + 1, int(np.searchsorted(total, total[at] + MEETINGS, side="right")) - 1)
                i, j = np.repeat(np.arange(at, to), (end - begin)[at:to]), ranges(begin[at:to], end[at:to])
                at = to
                fits = np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[fits], j[fits]
                overlap, need = _needs(n[i], n[j], t)
                fits = (sure[i] <= n[i] - overlap + need - 1) & (sure[j] <= n[j] - overlap + need - 1)
                a, b = of[i[fits]], of[j[fits]]
                if not len(a):
                    continue
                code, count = np.unique(np.minimum(a, b).astype(np.int64) * len(names) + np.maximum(a, b), return_counts=True)
                held.append((code, count))
                pairs += len(code)
                if pairs > 2 * MEETINGS:
                    held = [merged(held)]
                    pairs = len(held[0][0])
                    if pairs > MEETINGS:  # counts of a pair add up later
                        yield from batch(held)
                        held, pairs = [], 0
            if held:
                yield from batch(held)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gram set of each text, as sorted hashes."""
    for batch in text_chunks(batches, "text"):
        h, n = gram_sets(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("weight"), binary_rows(h, n)], ["name", "weight", "tokens"])


class Shared:
    """Overlaps of some sets: of few pairs one by one, of many by bitmaps over the grams that more than one set has."""

    def __init__(self, tokens: np.ndarray, begin: np.ndarray, n: np.ndarray):
        self.tokens, self.begin, self.n, self.column = tokens, begin, n, None

    def _grams(self) -> tuple[np.ndarray, np.ndarray]:
        return self.tokens[ranges(self.begin, self.begin + self.n)], np.repeat(np.arange(len(self.n)), self.n)

    def signatures(self) -> np.ndarray:
        out = np.zeros((len(self.n), BITS // 8), np.uint8)
        for k in range(0, len(self.n), 4096):
            n = self.n[k : k + 4096]
            bits = np.zeros((len(n), BITS), np.bool_)
            at = ranges(self.begin[k : k + 4096], self.begin[k : k + 4096] + n)
            bits[np.repeat(np.arange(len(n)), n), (self.tokens[at] & U(BITS - 1)).astype(np.int64)] = True
            out[k : k + 4096] = np.packbits(bits, axis=1)
        return out.view(U)

    def _columns(self) -> None:
        g, owner = self._grams()
        order = np.argsort(g, kind="stable")
        g, owner = g[order], owner[order]
        number = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        often = np.bincount(number) > 1
        keep = often[number]
        self.column, self.owner = (np.cumsum(often) - 1)[number][keep], owner[keep]
        self.width = max(64, MAP_BYTES * 8 // len(self.n) // 64 * 64)
        self.map = (-1, None)

    def _map(self, lo: int) -> np.ndarray:
        """Which sets have the grams from number lo on, ``width`` at most."""
        if self.map[0] != lo:
            a, b = np.searchsorted(self.column, (lo, lo + self.width))
            wide = (int(self.column[b - 1]) - lo) // 64 * 64 + 64
            bits, c = np.zeros((len(self.n), wide // 8), np.uint8), self.column[a:b] - lo
            np.bitwise_or.at(bits, (self.owner[a:b], c >> 3), (1 << (c & 7)).astype(np.uint8))
            self.map = (lo, bits.view(U))
        return self.map[1]

    def overlaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(i) <= FEW and self.column is None:
            both = (np.concatenate([self.tokens[self.begin[k] : self.begin[k] + self.n[k]] for k in pair]) for pair in zip(i.tolist(), j.tolist(), strict=True))
            return np.array([int((x[1:] == x[:-1]).sum()) for x in map(_sorted, both)], np.int64)
        if self.column is None:
            self._columns()
        out = np.zeros(len(i), np.int64)
        for lo in range(0, int(self.column[-1]) + 1 if len(self.column) else 0, self.width):
            bits = self._map(lo)
            step = max(1, MAP_BYTES // 2 // (bits.shape[1] * 8))
            for k in range(0, len(i), step):
                out[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64)
        return out


def _sorted(x: np.ndarray) -> np.ndarray:
    x.sort(kind="stable")
    return x


def _compare(t: float, counted: bool | None):
    """Pairs (a, b, jaccard) of a label's sets, or, where ``counted`` isn't None, pairs that connect what is connected; with it, links of each set (a, null, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, names, chunks, owns, weights, left, right, paired = (column_to_numpy(table, c) for c in ("key", "name", "chunk", "own", "weight", "left", "right", "pair"))
            tokens, sizes = rows_binary(table.column("tokens"), U)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held: list[tuple] = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                given = lo + np.flatnonzero(paired[lo:hi])
                rows = lo + np.flatnonzero(~paired[lo:hi])
                rows = rows[np.argsort(sizes[rows], kind="stable")]
                name, chunk, weight, n = names[rows], chunks[rows], weights[rows], sizes[rows]
                shared, links, root = Shared(tokens, begins[rows], n), np.zeros(len(n), np.int64), np.arange(len(n))
                if len(given):
                    by = np.argsort(name, kind="stable")
                    found = [tuple(by[np.searchsorted(name, side[given[k : k + FRONTIER]], sorter=by)] for side in (left, right)) for k in range(0, len(given), FRONTIER)]
                elif len(rows) <= LEAF:
                    found = [np.triu_indices(len(rows), 1)]
                else:
                    found = Tree(shared.signatures(), n).pairs(t)
                whole = bool(owns[rows].all())
                for i, j in found:
                    if not whole:
                        keep = chunk[i] != chunk[j]
                        i, j = i[keep], j[keep]
                    keep = np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    common = shared.overlaps(i, j)
                    jaccard = common / (n[i] + n[j] - common)
                    ok = jaccard >= t
                    i, j = i[ok], j[ok]
                    if counted is None:
                        held.append((name[i], name[j], jaccard[ok]))
                        if len(i) > LEAF * LEAF:
                            yield from _found(held)
                        continue
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    while len(i):  # the least place of all that hang together
                        x, y = root[i], root[j]
                        i, j, x, y = (v[x != y] for v in (i, j, x, y))
                        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                        while (root[root] != root).any():
                            root = root[root]
                if counted is not None:
                    at, some = np.flatnonzero(root != np.arange(len(n))), np.flatnonzero(links)
                    held.append((name[at], name[root[at]], np.zeros(len(at))))
                    if counted:
                        held.append((name[some], None, links[some]))
            yield from _found(held)

    return run


def _found(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What is held, as one batch; a missing second name is a null."""
    if held:
        two = [pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()) for a, b, _ in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _, _ in held])), pa.concat_arrays(two), pa.array(np.concatenate([v for _, _, v in held]).astype(np.float64))], ["a", "b", "value"])
    held.clear()


def _near(docs: DataFrame, signs: DataFrame, sets: DataFrame, scratch: Scratch, t: float, counted: bool | None, broadcast_ids: int) -> tuple[DataFrame, DataFrame]:
    """What _compare finds between names of sets, over all pairs that meet the threshold, and all sets by name (name, doc_id, th, weight)."""
    spark = docs.sparkSession
    votes = clustered(sets.select("name", F.explode("keys").alias("key")), "key").mapInArrow(_votes, "name long, label long")
    votes = votes.groupBy("name", "label").count().filter("count > 1")
    labels = scratch.write(votes.groupBy("name").agg(F.max_by("label", F.struct("count", F.bitwise_not("label"))).alias("label")), "labels")
    of = sets.select("name", "n", "row.doc_id", "row.th").join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    tiles = of.groupBy("label").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    weights = signs.filter("n > 0").select("name", "doc_id", "th").distinct().groupBy("name").agg(F.count("*").alias("weight"))
    of = of.join(tiles, "label").join(weights, "name").withColumn("chunk", F.pmod(F.xxhash64("name"), "tiles").cast("int"))
    of = scratch.write(of, "labelled")
    # sets of different labels that share enough of their rarest grams
    total, grams = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast(_frequencies(docs, sets, total))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams // PART)
    mark = scratch.write(signs.join(labels, "name").select(F.col("doc_id").alias("i"), F.col("th").alias("h"), "label").distinct(), "mark")
    marked = docs.join(F.broadcast(mark) if mark.count() <= broadcast_ids else mark, docs["doc_id"].eqNullSafe(mark["i"]) & (docs["th"] == mark["h"]), "left").select("text", "label")
    bits = max(parts - 1, 0).bit_length()
    posted = marked.mapInArrow(_postings(t, bits, frequent), "part int, sets binary, grams binary, places binary")
    posted = posted.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("part")
    met = posted.mapInArrow(_meetings(t), "a long, b long, na long, nb long, m long").groupBy("a", "b").agg(F.sum("m").alias("m"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9) - F.ceil(F.lit(t) * F.greatest("na", "nb") - 1e-9) + 1
    met = scratch.write(met.filter(F.col("m") >= need).select("a", "b"), "met")
    for side in ("a", "b"):
        met = met.join(of.select(F.col("name").alias(side), F.struct("label", "chunk").alias(f"of_{side}")), side)
    met = scratch.write(met.select(F.xxhash64(F.lit("two"), F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).alias("key"), "a", "b"), "pairs")
    # one row per set and place where it is compared, then the pairs that are given
    other = of.filter("m > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    inside = other.select(F.xxhash64(F.lit("one"), "label", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "name", "chunk", (F.col("chunk") == F.col("other")).alias("own"))
    across = met.select("key", F.explode(F.array("a", "b")).alias("name")).distinct().select("key", "name", F.lit(0).alias("chunk"), F.lit(True).alias("own"))
    member = scratch.write(inside.unionByName(across), "members")
    ids = scratch.write(of.join(member.select("name").distinct(), "name", "left_semi").select("name", F.col("doc_id").alias("i"), F.col("th").alias("h"), "weight"), "ids")
    sources = docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, docs["doc_id"].eqNullSafe(ids["i"]) & (docs["th"] == ids["h"]))
    sources = sources.select("name", "weight", "text").mapInArrow(_tokens, "name long, weight long, tokens binary").dropDuplicates(["name"])
    zero = F.lit(0).cast("long")
    shipped = member.join(sources, "name").select("key", "name", "chunk", "own", "weight", "tokens", zero.alias("left"), zero.alias("right"), F.lit(False).alias("pair"))
    given = met.select("key", zero.alias("name"), F.lit(0).alias("chunk"), F.lit(True).alias("own"), zero.alias("weight"), F.lit(b"").alias("tokens"), F.col("a").alias("left"), F.col("b").alias("right"), F.lit(True).alias("pair"))
    return scratch.write(clustered(shipped.unionByName(given), "key").mapInArrow(_compare(t, counted), "a long, b long, value double"), "near"), of


def _narrow(docs: DataFrame) -> DataFrame:
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("th", text_hash(docs))


def _signed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row per text (those without words have n = 0), and a row per gram set with its name, a hash of it, and the row that stands for it."""
    signs = scratch.write(docs.mapInArrow(_signatures, "doc_id long, th long, name long, two long, n int, keys array<long>"), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("row")
    sets = signs.filter("n > 0").groupBy("name", "two", "n").agg(least, F.first("keys").alias("keys"))
    return signs.drop("keys"), scratch.write(sets, "sets")


def similar_pairs(docs: DataFrame, t: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Pairs of documents with Jaccard of at least ``t`` (see the module)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = _narrow(docs).filter("doc_id IS NOT NULL")
    signs, sets = _signed(docs, scratch)
    names = sets.select("name", "two", "n", F.col("row.doc_id").alias("doc_a"))
    copies = signs.filter("n > 0").select("name", "two", "n", "doc_id").join(names, ["name", "two", "n"]).filter("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    near, of = _near(docs, signs, sets, scratch, t, None, broadcast_ids)
    for side in ("a", "b"):
        near = near.join(of.select(F.col("name").alias(side), F.col("doc_id").alias(f"id_{side}")), side)
    near = near.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), F.col("value").alias("jaccard"))
    return near.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def linked(docs: DataFrame, t: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, class_id, links): a row per document (see the module)."""
    scratch = Scratch(docs.sparkSession, "linked")
    docs = _narrow(docs).filter("doc_id IS NOT NULL")
    signs, sets = _signed(docs, scratch)
    near, of = _near(docs, signs, sets, scratch, t, True, broadcast_ids)
    edges = near.filter("b IS NOT NULL").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    below = groups(edges, scratch).select(F.col("doc_id").alias("name"), "first")
    links = near.filter("b IS NULL").groupBy(F.col("a").alias("name")).agg(F.sum("value").cast("long").alias("links"))
    classed = of.select("name", "doc_id", "weight").join(below, "name", "left").withColumn("first", F.coalesce("first", "name"))
    least = classed.groupBy("first").agg(F.min("doc_id").alias("class_id"))
    classed = classed.join(least, "first").join(links, "name", "left").select("name", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    rows = signs.select("doc_id", "th", F.when(F.col("n") > 0, F.col("name")).alias("name")).distinct()
    return rows.join(classed, "name", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def groups(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, first): the smallest id of each document's group, for documents that aren't it.

    Alternates the two star contractions: every round at least halves what is left
    of a long chain, and no node gathers its neighbours in memory.
    """
    edges = scratch.write(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct(), "edges_0")
    before, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        k += 1
        edges = scratch.write(small, f"edges_{k}")
        scratch.drop(f"edges_{k - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("first"))
        before = now


def deduplicated(docs: DataFrame, t: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The documents, with all their columns, of which one row of each group of near copies stays (see the module)."""
    scratch = Scratch(docs.sparkSession, "groups")
    need = _narrow(docs)
    signs, sets = _signed(need, scratch)
    near, of = _near(need, signs, sets, scratch, t, False, broadcast_ids)
    signs = signs.filter("n > 0")
    edges = near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    below = scratch.write(groups(edges, scratch), "below")
    group = below.select("doc_id", "first").unionByName(below.select(F.col("first").alias("doc_id"), "first").distinct())
    group = group.join(of.select(F.col("name").alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th").alias("row")), "doc_id").select("first", "row")
    stays = group.groupBy("first").agg(F.min("row").alias("least"))
    others = group.join(stays, "first").filter(~F.col("row").eqNullSafe(F.col("least"))).select("row.doc_id", "row.th")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    copies = signs.select("name", "two", "n", "doc_id", "th").join(sets.select("name", "two", "n", "row"), ["name", "two", "n"]).filter(~own.eqNullSafe(F.col("row"))).select("doc_id", "th")
    gone = scratch.write(others.unionByName(copies).distinct(), "gone")
    again = signs.groupBy("doc_id", "th").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id", "th")
    again = again.join(gone, again["doc_id"].eqNullSafe(gone["doc_id"]) & (again["th"] == gone["th"]), "left_anti")
    again = scratch.write(again, "again")
    for table in ("signatures", "sets", "labels", "labelled", "mark", "met", "pairs", "members", "ids", "near"):
        scratch.drop(table)
    kept = match_rows(docs, gone.unionByName(again), "left_anti", broadcast_ids)
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = match_rows(docs, again, "left_semi", broadcast_ids).groupBy(F.col("doc_id").cast("long").alias("i"), text_hash(docs).alias("t"))
    return kept.unionByName(once.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
