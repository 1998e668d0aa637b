"""Snapshots over time: levels, trends, retention. A snapshot row is (seq, module, score, level)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import RETENTION


def levels(snaps: DataFrame) -> DataFrame:
    count = lambda level: F.count_if(F.col("level") == level).alias(level.lower())
    return snaps.groupBy("seq").agg(count("HIGH"), count("MEDIUM"), count("LOW"))


def high_delta(snaps: DataFrame) -> DataFrame:
    """HIGH modules of each snapshot and the change since the one before (null for the first).

    The window runs over one row per snapshot, not over modules.
    """
    return levels(snaps).select("seq", "high", (F.col("high") - F.lag("high").over(Window.orderBy("seq"))).alias("delta"))


def latest(snaps: DataFrame, n: int) -> DataFrame:
    """Rows of the last n snapshots."""
    last = snaps.select("seq").distinct().orderBy(F.desc("seq")).limit(n)
    return snaps.join(F.broadcast(last), "seq", "left_semi")


def retained(snaps: DataFrame, n: int = RETENTION) -> DataFrame:
    return latest(snaps, n)


def pair(snaps: DataFrame, old: int | None = None, new: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two snapshots by 1-based index; the last two by default."""
    index = snaps.select("seq").distinct().withColumn("i", F.row_number().over(Window.orderBy("seq"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    pick = lambda i, back: snaps.join(F.broadcast(index.filter(F.col("i") == (F.lit(i) if i else F.col("n") - back))), "seq", "left_semi")
    return pick(old, 1), pick(new, 0)


def trend(snaps: DataFrame, n: int = 10) -> DataFrame:
    """Scores of every module over the last n snapshots (0 where it is missing), and the change from first to last."""
    recent = latest(snaps, n)
    grid = recent.select("module").distinct().crossJoin(F.broadcast(recent.select("seq").distinct()))
    filled = grid.join(recent.select("seq", "module", "score"), ["seq", "module"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    lists = filled.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "score"))), lambda x: x["score"]).alias("scores"))
    first, last = F.element_at("scores", 1), F.element_at("scores", -1)
    return lists.select("module", "scores", first.alias("first"), last.alias("last"), (last - first).alias("change"), S.sparkline(F.col("scores")).alias("spark"))
