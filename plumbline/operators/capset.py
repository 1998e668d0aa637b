"""Capability sets from evidence: build, merge, confidence, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def per_capability(evidence: DataFrame) -> DataFrame:
    """package, capability, confidence (mean, 0 when none is known) and how often it was seen.

    The sum is one of decimals: that of doubles depends on the order of rows, and a mean of 0.70 came out below 0.70 or not.
    """
    mean = F.avg(F.col("confidence").try_cast("decimal(18,12)")).cast("double")
    return evidence.groupBy("package", "capability").agg(F.coalesce(mean, F.lit(0.0)).alias("confidence"), F.count("*").alias("n_evidence"))


def build(evidence: DataFrame) -> DataFrame:
    """package, caps (sorted), score: each capability's weight once."""
    once = evidence.groupBy("package", "capability").agg(F.lit(1).alias("one"))
    return once.groupBy("package").agg(F.array_sort(F.collect_list("capability")).alias("caps"), F.sum(S.weight(F.col("capability"))).cast("long").alias("score"))


def merge(*evidence: DataFrame) -> DataFrame:
    """Evidence of several sets as one."""
    out = evidence[0]
    for e in evidence[1:]:
        out = out.unionByName(e)
    return out


def has(caps: Column, capability: str) -> Column:
    return F.array_contains(caps, capability)


def text(caps: Column) -> Column:
    return F.array_join(caps, ",")


def is_empty(caps: Column) -> Column:
    return F.size(caps) == 0


def without(evidence: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Evidence less (package, capability) exceptions; capabilities compare in lower case."""
    ex = exceptions.select(F.col("package").alias("__p"), F.lower("capability").alias("__c"))
    return evidence.join(ex, (evidence["package"] == ex["__p"]) & (F.lower(evidence["capability"]) == ex["__c"]), "left_anti")


def hide_low_confidence(per_cap: DataFrame, least: float) -> DataFrame:
    """Drop capabilities whose mean confidence is known and below ``least``."""
    return per_cap.filter(~((F.col("confidence") > 0) & (F.col("confidence") < least)))


def top_evidence(evidence: DataFrame, n: int = 3) -> DataFrame:
    """The first n pieces of evidence of each package and capability, and how many there are."""
    each = Window.partitionBy("package", "capability")
    order = each.orderBy(F.desc("confidence"), "file", "line", "via")
    ranked = evidence.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(each))
    return ranked.filter(F.col("rank") <= n)


def module_max(sets: DataFrame, packages: DataFrame) -> DataFrame:
    """Largest package score of each module; main packages and those of no module don't count."""
    inside = packages.filter(F.col("module").isNotNull() & ~F.col("is_main")).join(sets, "package", "left")
    return inside.groupBy("module").agg(F.coalesce(F.max("score"), F.lit(0)).cast("long").alias("score"))


def module_argmax(sets: DataFrame, packages: DataFrame) -> DataFrame:
    """The package with the largest score of each module; of equals the smallest name."""
    inside = packages.filter(F.col("module").isNotNull() & ~F.col("is_main")).join(sets, "package")
    best = F.min_by(F.struct("package", "score"), F.struct((-F.col("score")).alias("first"), "package"))
    return inside.groupBy("module").agg(best.alias("b")).select("module", "b.package", "b.score")
