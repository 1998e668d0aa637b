"""Comparisons: versions, capability sets, snapshots, pull requests, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ESCALATING = ["exec", "network", "unsafe", "plugin"]


def new_packages(head: DataFrame, base: DataFrame) -> DataFrame:
    return head.join(base.select("package"), "package", "left_anti")


def versions(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, removed and updated packages of a change; both sides are (package, version)."""
    b, h = base.select("package", F.col("version").alias("old_version")), head.select("package", F.col("version").alias("new_version"))
    both = b.join(h, "package", "full_outer")
    kind = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "updated")
    return both.withColumn("change", kind).filter("change IS NOT NULL")


def capabilities(old: DataFrame, new: DataFrame) -> DataFrame:
    """package, added, removed, escalated of (package, caps) sets that differ."""
    none = F.array().cast("array<string>")
    both = old.select("package", F.col("caps").alias("o")).join(new.select("package", F.col("caps").alias("n")), "package", "full_outer")
    o, n = F.coalesce("o", none), F.coalesce("n", none)
    both = both.select("package", F.array_sort(F.array_except(n, o)).alias("added"), F.array_sort(F.array_except(o, n)).alias("removed"))
    return both.filter((F.size("added") > 0) | (F.size("removed") > 0)).withColumn("escalated", escalated(F.col("added")))


def escalated(added: Column) -> Column:
    return F.arrays_overlap(added, F.array(*[F.lit(c) for c in ESCALATING]))


def snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Module by module: added, removed, escalated, improved, or unchanged."""
    o = old.select("module", F.col("score").alias("old_score"), F.col("level").alias("old_level"))
    n = new.select("module", F.col("score").alias("new_score"), F.col("level").alias("new_level"))
    kind = F.when(F.col("old_score").isNull(), "added").when(F.col("new_score").isNull(), "removed").when(F.col("new_score") > F.col("old_score"), "escalated").when(F.col("new_score") < F.col("old_score"), "improved").otherwise("unchanged")
    return o.join(n, "module", "full_outer").withColumn("change", kind)


def risk_deltas(changes: DataFrame, ecosystem: str = "go", caps: DataFrame | None = None) -> DataFrame:
    """Points per changed package (15, 8 or 0) from what its new version can do.

    ``caps`` (package, caps) are the new version's capabilities where known; else
    they are guessed from the name. Only added packages score by themselves; an
    update scores what it adds.
    """
    if caps is None:
        named = changes.withColumn("__caps", S.inferred_caps(F.col("package").cast("string"), ecosystem))
    else:
        named = changes.join(caps.select("package", F.col("caps").alias("__caps")), "package", "left")
    level = S.caps_level(F.coalesce("__caps", F.array().cast("array<string>")))
    return named.withColumn("level", level).withColumn("delta", F.when(F.col("change") == "added", S.level_delta(level)).otherwise(0)).drop("__caps")


def capped_sum(rows: DataFrame, points: str, cap: int = 20) -> DataFrame:
    return rows.agg(F.least(F.lit(cap), F.coalesce(F.sum(points), F.lit(0))).cast("long").alias("score"))


def package_diff_score(packages: DataFrame, deltas: DataFrame) -> DataFrame:
    """Sum of deltas whose versioned name is the package or begins with package@."""
    name, _ = S.split_at(F.col("package"))
    by_name = deltas.withColumn("name", name).groupBy("name").agg(F.sum("delta").cast("long").alias("diff_score"))
    return packages.join(by_name, packages["package"] == by_name["name"], "left").select("package", F.coalesce("diff_score", F.lit(0)).alias("diff_score"))


def merged(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Union in which b's rows replace a's rows of the same key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__rank"))
    both = a.withColumn("__rank", F.lit(0)).unionByName(b.withColumn("__rank", F.lit(1)))
    return both.withColumn("__r", F.rank().over(w)).filter("__r = 1").drop("__r", "__rank")


def equal_sets(a: DataFrame, b: DataFrame, epsilon: float = 0.001) -> bool:
    """Whether two (key, value) tables have the same keys and values within epsilon."""
    keys = [c for c in a.columns if c != "value"]
    other = b.withColumnRenamed("value", "__v")
    return a.join(other, keys, "full_outer").filter("value IS NULL OR __v IS NULL OR abs(value - __v) > " + str(epsilon)).isEmpty()


def symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking changes: exported symbols removed, or whose type differs."""
    n = new.select("package", "symbol", F.col("type").alias("new_type"))
    kind = F.when(F.col("new_type").isNull(), "removed").when(F.col("type") != F.col("new_type"), "type changed")
    return old.join(n, ["package", "symbol"], "left").withColumn("change", kind).filter("change IS NOT NULL")
