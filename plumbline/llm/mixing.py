"""Mixing sources to target weights by fitting token budgets exactly.

Tokens are those that ``tokens`` counts with the unigram vocabulary at ``path``; the
query and the pipeline give that of operator 4. Without a path they are the words of
``textops``. Each text is counted once.

Documents are counted by source and exact token length. Each source gets a budget
in proportion to its weight; a source with fewer tokens gives all it has and the
rest is shared among the others. Per source, the same share of every length is
taken first; the budget that remains is fitted by bounded-knapsack dynamic
programming over the lengths that are left. While that can't meet it exactly, more of
the even share is given back, up to a window of ``cells`` tokens. So many documents of each length are
then selected in the order of a seeded hash: the cut of the hash is known for each
source and length, so that texts are selected where they are, without a shuffle,
from a copy that is written with their counts. To find a cut, hashes are counted in
ranges of some ``CLASS_ROWS`` rows, and only the range that holds the cut is ordered.

Weights: a dict by source (a source that isn't in it gets none), or None for
(tokens of the source) ** ``temper``. The whole budget is ``share`` of all tokens,
or of those of sources with weight.

Defined results: null and empty texts have no tokens and are never selected; null is
a source of its own (weights may hold None); rows that are equal in id and text tie,
and are taken or left together: left where only some would fit; a null id is
selected like another; an empty table gives none; the budget is never exceeded, and
is met exactly whenever the lengths within the window allow it; columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, fresh, pick, ship
from .textops import buffers, text_chunks, words
from .tokens import CHUNK, VOCABULARY, counter

SHARE, TEMPER, SEED = 0.9, 0.7, 2024
#: Tokens that dynamic programming looks at: the budget left after the even share, and what is given back to meet it.
CELLS = 1 << 21
#: Source and length classes (about 40 bytes each) up to which what is known of them is broadcast; beyond that it is joined by a shuffle.
BROADCAST_CUTS = 1_000_000
#: Rows of a class that are ordered at once, about.
CLASS_ROWS = 4096
LAST = (1 << 63) - 1


def token_lengths(batch: pa.RecordBatch, path: str | None) -> pa.Array:
    """Exact tokens of each text."""
    if path is None:
        return pa.array(np.diff(words(*buffers(batch.column("text"))).first), pa.int64())
    return pa.array(counter(path).texts(batch.column("text")), pa.int64())


def _counted(docs: DataFrame, path: str | None, seed: int) -> tuple[DataFrame, str, str]:
    """The documents with their seeded hash and tokens, and the names of these two columns."""
    ship(docs.sparkSession)
    h, n = fresh(docs, "__h"), fresh(docs, "__n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([*batch.columns, token_lengths(batch, path)], [*batch.schema.names, n])

    hashed = docs.withColumn(h, F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"].cast("string")))
    return hashed.mapInArrow(run, StructType([*hashed.schema, StructField(n, LongType())])), h, n


def _lengths(counted: DataFrame, h: str, n: str) -> DataFrame:
    return counted.select("doc_id", F.col("source").cast("string").alias("source"), F.col(n).alias("n_tokens"), F.col(h).alias("h"), _key().alias("key"))


def lengths(docs: DataFrame, path: str | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, its key, n_tokens and seeded hash of each row."""
    need = pick(docs, "doc_id", "text", "source").withColumn("text", F.col("text").cast("string"))
    return _lengths(*_counted(need, path, seed))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def waterfill(total: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Whole budgets in proportion to weights, none above its total."""
    out = np.zeros(len(total))
    open_ = weight > 0
    left = float(min(budget, total[open_].sum()))
    while open_.any():
        level = left / weight[open_].sum()
        capped = open_ & (total <= weight * level * (1 + 1e-12))
        if not capped.any():
            out[open_] = weight[open_] * level
            break
        out[capped] = total[capped]
        left -= total[capped].sum()
        open_ &= ~capped
    return np.minimum(np.floor(out + 1e-6), total).astype(np.int64)


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (> 0) to take for the largest sum up to ``budget``."""
    take = np.zeros(len(size), np.int64)
    best = np.zeros(budget + 1, bool)
    best[0] = True
    item, many = np.full(budget + 1, -1, np.int64), np.zeros(budget + 1, np.int64)
    for i in range(len(size)):
        rest, k = int(min(count[i], budget // size[i])), 1
        while rest > 0 and not best[budget]:
            k = min(k, rest)
            step = int(size[i]) * k
            if step <= budget:
                new = np.flatnonzero(best[: budget + 1 - step] & ~best[step:]) + step
                best[new], item[new], many[new] = True, i, k
            rest -= k
            k *= 2
    at = int(np.flatnonzero(best)[-1])
    while at > 0:
        i, k = item[at], many[at]
        take[i] += k
        at -= int(size[i] * k)
    return take


def fit(size: np.ndarray, count: np.ndarray, budget: int, seed: int = SEED, cells: int = CELLS) -> np.ndarray:
    """How many documents of each length to take so that their tokens are at most, and mostly just, the budget.

    An even share comes first, then single documents until little is left, then dynamic
    programming over what is left; while it misses, some of each length are given back.
    """
    size, count = np.asarray(size, np.int64), np.asarray(count, np.int64)
    total = int((size * count).sum())
    if budget >= total:
        return count.copy()
    if budget <= 0:
        return np.zeros(len(size), np.int64)
    share = budget / total
    take = np.minimum(np.floor(count * share).astype(np.int64), count)
    rest = budget - int((take * size).sum())
    order = np.random.default_rng([seed, len(size)]).permutation(len(size))
    window = min(cells, 4 * int(size.max()))
    for i in sorted(order, key=lambda i: -(count[i] * share - take[i])):
        if rest <= window:
            break
        if size[i] <= rest and take[i] < count[i]:
            take[i] += 1
            rest -= int(size[i])
    for i in np.argsort(-size, kind="stable"):
        if rest <= cells:
            break
        more = min(int(count[i] - take[i]), rest // int(size[i]))
        take[i] += more
        rest -= more * int(size[i])
    give = 0
    while True:
        left = count - take
        fine = order[(size[order] <= rest) & (left[order] > 0)]
        more = np.zeros(len(size), np.int64)
        more[fine] = knapsack(size[fine], left[fine], rest)
        some = (left > 0) & (size <= rest)
        unit = int(np.gcd.reduce(size[some])) if some.any() else 1
        if int((more * size).sum()) >= rest - rest % unit and not (rest % unit and (take > 0).any()):
            return take + more
        before, give = rest, 2 * give + 1
        for i in order:  # as many of each length as fit into the window
            back = int(min(take[i], give, max(0, cells - rest) // size[i]))
            take[i] -= back
            rest += back * int(size[i])
        if rest == before:
            return take + more


def cuts(lens: DataFrame, weights: dict | None = None, share: float = SHARE, temper: float = TEMPER, seed: int = SEED, broadcast_cuts: int = BROADCAST_CUTS, class_rows: int = CLASS_ROWS) -> DataFrame:
    """key, n_tokens, cut: rows of this source and length whose hash is at most the cut are selected."""
    spark = lens.sparkSession
    ship(spark)
    scratch = Scratch(spark, "cuts")
    classes = lens.filter("n_tokens > 0").groupBy("key", "n_tokens").agg(F.count("*").alias("c"))
    classes = scratch.write(classes, "classes")
    totals = classes.groupBy("key").agg(F.sum(F.col("c") * F.col("n_tokens")).alias("total"))
    table = None if weights is None else {"n" if k is None else f"s{k}": float(v) for k, v in weights.items()}

    def budgets(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("key")
        total = t.total.to_numpy(np.int64)
        weight = total.astype(float) ** temper if table is None else t.key.map(table).fillna(0).to_numpy(float)
        return pd.DataFrame({"key": t.key, "budget": waterfill(total, weight, share * total[weight > 0].sum())})

    def takes(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("n_tokens")
        take = fit(t.n_tokens.to_numpy(), t.c.to_numpy(), int(t.budget.iloc[0]), seed)
        return pd.DataFrame({"key": t.key, "n_tokens": t.n_tokens, "c": t.c, "take": take})[take > 0]

    per_source = totals.groupBy(F.lit(1).alias("all")).applyInPandas(budgets, "key string, budget long")  # one row a source
    take = classes.join(per_source, "key").groupBy("key").applyInPandas(takes, "key string, n_tokens long, c long, take long")
    # 2^bits ranges of hashes for a class
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / class_rows))).cast("int")
    take = scratch.write(take.withColumn("bits", bits), "take")
    few = take.count() <= broadcast_cuts
    of = ["key", "n_tokens"]
    whole = take.filter("take >= c").select(*of, F.lit(LAST).alias("cut"))
    part = take.filter("take < c")
    placed = lens.select(*of, "h").join(F.broadcast(part) if few else part, of).withColumn("bin", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftright(h, 64 - bits) END"))
    bins = placed.groupBy(*of, "bin").agg(F.count("*").alias("m"), F.first("take").alias("take"), F.first("bits").alias("bits"))
    upto = F.sum("m").over(Window.partitionBy(*of).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    edge = bins.withColumn("before", upto - F.col("m")).filter("before < take AND take <= before + m")
    edge = scratch.write(edge.select(*of, "bin", "take", "bits", "before"), "edges")
    inside = placed.select(*of, "bin", "h").join(F.broadcast(edge) if few else edge, [*of, "bin"])
    rank = F.count("*").over(Window.partitionBy(*of).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("rank", rank).filter("before + rank <= take").groupBy(*of).agg(F.max("h").alias("last"))
    below = F.expr("CASE WHEN before > 0 THEN shiftleft(bin, 64 - bits) - 1 END")
    found = edge.join(last, of, "left").select(*of, F.coalesce("last", below).alias("cut")).filter("cut IS NOT NULL")
    return whole.unionByName(found)


def _chosen(rows: DataFrame, key: Column, n: Column, h: Column, cut: DataFrame, broadcast_cuts: int) -> DataFrame:
    """The rows whose hash is at most the cut of their source and length."""
    cut = cut.select(F.col("key").alias("__key"), F.col("n_tokens").alias("__n"), F.col("cut").alias("__cut"))
    few = cut.count() <= broadcast_cuts
    return rows.join(F.broadcast(cut) if few else cut, (key == cut["__key"]) & (n == cut["__n"]) & (h <= cut["__cut"]), "left_semi")


def selected(lens: DataFrame, broadcast_cuts: int = BROADCAST_CUTS, **how) -> DataFrame:
    """doc_id, source and n_tokens of the rows that are selected."""
    cut = Scratch(lens.sparkSession, "mixing").write(cuts(lens, broadcast_cuts=broadcast_cuts, **how), "cuts")
    return _chosen(lens, lens["key"], lens["n_tokens"], lens["h"], cut, broadcast_cuts).select("doc_id", "source", "n_tokens")


def mixed(docs: DataFrame, path: str | None = None, seed: int = SEED, broadcast_cuts: int = BROADCAST_CUTS, **how) -> DataFrame:
    """The documents, with all their columns, that are selected. Texts aren't shuffled while the cuts are few."""
    scratch = Scratch(docs.sparkSession, "mixing")
    counted, h, n = _counted(docs, path, seed)
    counted = scratch.write(counted, "counted")
    lens = _lengths(counted, h, n)
    cut = scratch.write(cuts(lens, seed=seed, broadcast_cuts=broadcast_cuts, **how), "cuts")
    if cut.count() <= broadcast_cuts:
        return _chosen(counted, _key(), counted[n], counted[h], cut, broadcast_cuts).drop(h, n)
    # narrow rows meet the cuts; texts then meet what is chosen by their hash, so that no class gathers in one task
    chosen = _chosen(lens, lens["key"], lens["n_tokens"], lens["h"], cut, broadcast_cuts).select(F.col("key").alias("__key"), F.col("n_tokens").alias("__n"), F.col("h").alias("__cut")).distinct()
    same = (counted[h] == chosen["__cut"]) & (_key() == chosen["__key"]) & (counted[n] == chosen["__n"])
    return counted.join(chosen, same, "left_semi").drop(h, n)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    lens = Scratch(spark, "mixing").write(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY), "lengths")
    return selected(lens)
