"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed for many documents at once from their bytes and word
hashes. Trees are grown on histograms with logistic loss; features named in
``MONOTONE`` may only push the score one way, which is kept by refusing splits
of the wrong order and by bounding what is below a split. For scoring, all trees
are flattened into node arrays and walked level by level for a whole batch.

A document is accepted when its score is at least 0.5. Labels with quality 0 or
toxic 1 are what is to be rejected. One statistic counts distinct flagged words
and beginnings of words: those whose documents were mostly labelled toxic, learnt
from the same labelled rows.

Bound: the model is fitted on at most ``sample`` labelled documents (default
10,000, those with the smallest seeded hash of their id, so that repeated rows change
nothing; of rows of one id the text with the smallest hash is learnt from); near copies among them
count once. Everything is scored. Of the sample only statistics, and the flagged words, come to the
driver: words are counted by an aggregate.

Defined results: a null or empty text, or one without words, scores 0 and is
rejected; repeated rows and ties get the same score each; labels and texts without an id,
and labels without quality and toxicity, aren't learnt from, of repeated labels the worst is; with no labelled rows,
or labels of one kind only, every document that has words is accepted with score
1; columns besides the id and the text are carried along untouched by
``accepted`` and ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, lowest, pick, rows_binary, ship
from .textops import U, buffers, grams, mix, ranges, span_of, text_chunks, words

SAMPLE, SEED, CUT = 10_000, 17, 0.5
#: Minima of trigram hashes by which near copies among labelled rows are found.
MINIMA = 12
#: Bytes of the beginnings of words that can be flagged.
PREFIXES = (4, 5, 6)
FEATURES = ["chars", "words", "word_bytes", "upper", "digits", "marks", "symbols", "pipes", "bangs", "wide", "blank", "line_words", "distinct_words", "top_word", "echo", "distinct_lines", "flagged", "flagged_share"]
#: +1: more can't lower the score; -1: more can't raise it.
MONOTONE = {"symbols": -1, "pipes": -1, "bangs": -1, "echo": -1, "top_word": -1, "distinct_lines": 1, "flagged": -1, "flagged_share": -1}
DOCUMENT_SCORES = "doc_id long, score double"

_CLASS = {
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "marks": [ord(c) for c in ".,;:'\"-()?"],
    "symbols": [ord(c) for c in "#$%&*@^~+=<>{}[]\\/_`"],
    "pipes": [ord("|")],
    "bangs": [ord("!")],
    "wide": [*range(0xC0, 256)],
    "blank": [9, 10, 13, 32],
}


def statistics(raw: np.ndarray, offsets: np.ndarray, flagged: np.ndarray) -> tuple[np.ndarray, object]:
    """A row of FEATURES per document, and the words they were taken from."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    chars = np.maximum(table.sum(1) - table[:, 0x80:0xC0].sum(1), 1)
    w = words(raw, offsets)
    doc, per = w.doc(), np.diff(w.first)
    safe = np.maximum(per, 1)
    out = {name: table[:, cols].sum(1) / chars for name, cols in _CLASS.items()}
    out |= {"chars": np.log1p(chars), "words": np.log1p(per), "word_bytes": np.bincount(doc, w.end - w.start, n) / safe}
    _, first, count = np.unique(_salted(w.hash, doc), return_index=True, return_counts=True)
    out["distinct_words"] = np.bincount(doc[first], minlength=n) / safe
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[first], count)
    out["top_word"] = top / safe
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]))
    out["echo"] = np.bincount(doc[same], minlength=n) / safe
    breaks = np.unique(np.concatenate([np.flatnonzero(raw == 10), offsets[:-1]]))
    line = np.searchsorted(breaks, w.start, side="right")
    heads = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(doc, prepend=-1))
    lines = np.bincount(doc[heads], minlength=n)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(w.hash, heads) if len(heads) else np.zeros(0, U)
    _, first = np.unique(_salted(mix(sums), doc[heads]), return_index=True)
    out["distinct_lines"] = np.bincount(doc[heads][first], minlength=n) / np.maximum(lines, 1)
    out["line_words"] = per / np.maximum(lines, 1)
    hits = [(np.zeros(0, np.int64), np.zeros(0, U))]
    if len(flagged) and len(w.hash):
        for at, key in _keys(w):
            hit = flagged[np.minimum(np.searchsorted(flagged, key), len(flagged) - 1)] == key
            hits.append((doc[at[hit]], key[hit]))
    owner, key = (np.concatenate(z) for z in zip(*hits, strict=True))
    _, first = np.unique(_salted(key, owner), return_index=True)
    out["flagged"] = np.bincount(owner[first], minlength=n)
    out["flagged_share"] = out["flagged"] / safe
    return np.stack([np.asarray(out[f], float) for f in FEATURES], 1), w


def _salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h ^ mix(doc.astype(U) + U(0x51))


def _keys(w) -> list[tuple[np.ndarray, np.ndarray]]:
    """What can be flagged: words, and the beginnings of words, as inflected forms share them."""
    return [(np.arange(len(w.hash)), w.hash), *(w.prefix(n) for n in PREFIXES)]


class Forest:
    """Trees as node arrays: a leaf is its own child, so every walk takes ``depth`` steps."""

    def __init__(self, base: float, roots, feature, threshold, left, right, value, depth: int):
        self.base, self.depth = base, depth
        self.roots, self.feature, self.left, self.right = (np.asarray(x, np.int32) for x in (roots, feature, left, right))
        self.threshold, self.value = np.asarray(threshold, float), np.asarray(value, float)

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, least: int = 12, l2: float = 1.0) -> Forest:
    """Boosted trees of logistic loss; deterministic in the order of rows."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1)
    flat = binned + np.arange(k) * bins
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    f = np.full(n, base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(v)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(node(0.0))
        level = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for d in range(depth + 1):
            below = []
            for at, rows, lo, hi in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                own = float(np.clip(gs / (hs + l2), lo, hi))
                value[at] = own * rate
                f[rows] += own * rate if d == depth or len(rows) < 2 * least else 0.0
                if d == depth or len(rows) < 2 * least:
                    continue
                cells = flat[rows].ravel()
                gw, hw, cw = (np.bincount(cells, np.repeat(z, k), k * bins).reshape(k, bins).cumsum(1) for z in (g[rows], h[rows], np.ones(len(rows))))
                gl, hl, cl = gw[:, :-1], hw[:, :-1], cw[:, :-1]
                gr, hr, cr = gs - gl, hs - hl, len(rows) - cl
                wl, wr = np.clip(gl / (hl + l2), lo, hi), np.clip(gr / (hr + l2), lo, hi)
                gain = gl * wl - 0.5 * (hl + l2) * wl**2 + gr * wr - 0.5 * (hr + l2) * wr**2 - (gs * own - 0.5 * (hs + l2) * own**2)
                fine = (cl >= least) & (cr >= least) & ((wr - wl) * monotone[:, None] >= 0)
                gain = np.where(fine, gain, -np.inf)
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if not gain[j, b] > 1e-6:
                    f[rows] += own * rate
                    continue
                low = binned[rows, j] <= b
                a, c = node(0.0), node(0.0)
                feature[at], threshold[at], left[at], right[at] = j, edges[j][min(b, len(edges[j]) - 1)], a, c
                mid = (wl[j, b] + wr[j, b]) / 2
                up, down = monotone[j] > 0, monotone[j] < 0
                below += [(a, rows[low], mid if down else lo, mid if up else hi), (c, rows[~low], mid if up else lo, mid if down else hi)]
            level = below
    return Forest(base, roots, feature, threshold, left, right, value, depth)


class Model:
    """Flagged words and trees; ``forest`` is None when there was nothing to learn from."""

    def __init__(self, flagged: np.ndarray, forest: Forest | None):
        self.flagged, self.forest = flagged, forest

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, w = statistics(raw, offsets, self.flagged)
        s = np.ones(len(x)) if self.forest is None else self.forest.score(x)
        return np.where(np.diff(w.first) > 0, s, 0.0)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document: statistics, its distinct words and beginnings of words, and minima for finding near copies."""
    seeds = [U(2 * i + 0x9E3779B1) for i in range(MINIMA)]
    for batch in text_chunks(batches, "text"):
        x, w = statistics(*buffers(batch.column("text")), np.zeros(0, U))
        per = np.diff(w.first)
        g, lo, hi = grams(w, 3)
        some = np.flatnonzero(hi > lo)
        minima = np.zeros((len(x), MINIMA), U)
        short = np.flatnonzero((per > 0) & (hi <= lo))
        for i in short.tolist():  # texts of one or two words are copies of equal ones
            minima[i] = mix(np.array(seeds, U) ^ U(span_of(w.hash[w.first[i] : w.first[i + 1]])))
        if len(some):
            own = g[ranges(lo[some], hi[some])]
            cuts = np.concatenate([[0], np.cumsum((hi - lo)[some])[:-1]])
            with np.errstate(over="ignore"):
                for i, a in enumerate(seeds):
                    minima[some, i] = np.minimum.reduceat(mix(own * a), cuts)
        doc, keys = w.doc(), _keys(w)
        owner, key = np.concatenate([doc[at] for at, _ in keys]), np.concatenate([k for _, k in keys])
        _, once = np.unique(_salted(key, owner), return_index=True)
        once = once[np.argsort(owner[once], kind="stable")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("bad"), pa.array(per), binary_rows(x.ravel(), np.full(len(x), x.shape[1])), binary_rows(key[once], np.bincount(owner[once], minlength=len(x))), binary_rows(minima.ravel(), np.full(len(x), MINIMA))],
            ["doc_id", "bad", "n_words", "x", "keys", "minima"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Learn flagged words and trees from at most ``sample`` labelled documents."""
    labels = pick(labels, "doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    toxic = F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (bad + 2 * toxic).alias("bad")).dropna()
    ids = labelled.agg(F.approx_count_distinct("doc_id")).first()[0]
    chosen = (
        labelled.filter(lowest(F.xxhash64("doc_id", F.lit(seed)), sample, F.lit(ids)))
        .groupBy("doc_id")
        .agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample)
    )
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("least")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "bad").agg(one).select("doc_id", "bad", "least.text")
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(rows.mapInArrow(_profiles, "doc_id long, bad int, n_words long, x binary, keys binary, minima binary"), "profiles")
    got = rows.filter("n_words > 0").select("doc_id", "bad", "n_words", "x", "minima").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return Model(np.zeros(0, U), None)
    x = rows_binary(got.column("x"), np.float64)[0].reshape(-1, len(FEATURES)).copy()
    minima = rows_binary(got.column("minima"), U)[0].reshape(-1, MINIMA)
    n_words, kind, doc = (got.column(c).to_numpy() for c in ("n_words", "bad", "doc_id"))
    seen: set = set()
    keep = []
    for i in range(len(x)):  # rows that agree in two neighbouring minima are near copies; the first stays
        marks = {(j, int(minima[i, j]), int(minima[i, j + 1])) for j in range(MINIMA - 1)}
        if not marks & seen:
            keep.append(i)
        seen |= marks
    keep = np.array(keep, np.int64)
    y = (kind[keep] == 0).astype(float)
    if y.min() == y.max():
        return Model(np.zeros(0, U), None)
    flagged, hits = _flagged(rows, doc[keep], kind[keep] == 3)
    x[keep, FEATURES.index("flagged")], x[keep, FEATURES.index("flagged_share")] = hits, hits / n_words[keep]
    monotone = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return Model(flagged, grow(x[keep], y, monotone))


def _flagged(rows: DataFrame, doc: np.ndarray, toxic: np.ndarray, share: float = 0.03, purity: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Words in at least ``share`` of toxic documents (and 4) of which ``purity`` of all documents with it are toxic, and how many each document has."""
    if not toxic.any():
        return np.zeros(0, U), np.zeros(len(doc))
    held = rows.sparkSession.sparkContext.broadcast((np.sort(doc), toxic[np.argsort(doc)]))

    def kept(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, is_toxic = held.value
        own = batch.column("doc_id").to_numpy()
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        key, n = rows_binary(batch.column("keys"), U)
        row = np.repeat(np.arange(len(n)), n)
        mine = (ids[at] == own)[row]
        return own, row[mine], key[mine], is_toxic[at][row[mine]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, key, bad = kept(batch)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bad.astype(np.int64))], ["key", "toxic"])

    need = max(4, share * toxic.sum())
    counts = rows.mapInArrow(spread, "key long, toxic long").groupBy("key").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    found = counts.filter((F.col("bad") >= need) & (F.col("bad") >= purity * F.col("all"))).select("key").toArrow()
    flagged = np.sort(found.column("key").to_numpy().view(U))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, row, key, _ = kept(batch)
            many = np.bincount(row[np.isin(key, flagged)], minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own[many > 0]), pa.array(many[many > 0])], ["doc_id", "hits"])

    hits = np.zeros(len(doc))
    if len(flagged):
        got = rows.mapInArrow(hit, "doc_id long, hits long").toArrow()
        order = np.argsort(doc)
        hits[order[np.searchsorted(doc[order], got.column("doc_id").to_numpy())]] = got.column("hits").to_numpy()
    return flagged, hits


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(*buffers(batch.column("text"))))], ["doc_id", "score"])

    need = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, DOCUMENT_SCORES)


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents, with all their columns, that the model accepts."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            yield batch.filter(pa.array(held.value.score(*buffers(batch.column("text"))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that are accepted, with their scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, fit(docs, labels)).filter(F.col("score") >= CUT)
