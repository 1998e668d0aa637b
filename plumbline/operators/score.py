"""Composite and final scores of packages, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def reach_modifier(reachable: Column, unknown_as_false: bool = False) -> Column:
    """1.3 reachable, 0.5 not, 1.0 unknown (0.5 where unknown counts as not)."""
    return F.when(reachable, 1.3).when(~reachable, 0.5).otherwise(0.5 if unknown_as_false else 1.0)


def taint_modifier(high: Column, medium: Column) -> Column:
    return 1.0 + 0.25 * F.coalesce(high, F.lit(0)) + 0.15 * F.coalesce(medium, F.lit(0))


def cve_modifier(n: Column) -> Column:
    return F.least(F.lit(2.0), 1.0 + 0.3 * F.coalesce(n, F.lit(0)))


def composite(sets: DataFrame, taints: DataFrame, hints: DataFrame, cves: DataFrame) -> DataFrame:
    """Capability score x reachability x CVEs x taint, at most 100."""
    all_ = sets.join(taints, "package", "left").join(hints, "package", "left").join(cves, "package", "left")
    value = F.least(F.lit(100.0), F.col("score") * reach_modifier(F.col("reachable")) * cve_modifier(F.col("n_cve")) * taint_modifier(F.col("high"), F.col("medium")))
    return all_.select("package", F.col("score").alias("cap_score"), value.alias("composite"), S.risk_level(value).alias("level"))


def final(sets: DataFrame, taints: DataFrame, hints: DataFrame, engines: DataFrame, unknown_as_false: bool = False) -> DataFrame:
    """Semantic score (at most 100) plus the project's engine scores, at most 100.

    ``engines`` is one row (diff, integrity, topology): the scores are project-wide.
    """
    semantic = F.least(F.lit(100.0), F.col("score") * reach_modifier(F.col("reachable"), unknown_as_false) * taint_modifier(F.col("high"), F.col("medium")))
    all_ = sets.join(taints, "package", "left").join(hints, "package", "left").crossJoin(F.broadcast(engines))
    total = F.least(F.lit(100.0), F.col("semantic") + F.col("diff") + F.col("integrity") + F.col("topology"))
    return all_.withColumn("semantic", semantic).withColumn("final", total).withColumn("level", S.risk_level(F.col("final"))).select("package", "caps", "score", "semantic", "final", "level")


def verdict(gated: DataFrame, denied: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """One row: passed, and the first failing package's reason, by package; a row per failing project where both tables have one.

    The score is checked before denied capabilities of the same package.
    """
    own = [c for c in ("project",) if c in gated.columns and c in denied.columns]
    by_score = gated.filter(S.meets(F.col("level"), fail_on)).select(*own, "package", F.lit(0).alias("o"), F.concat(F.lit("risk "), F.col("level"), F.lit(" in package "), F.col("package").cast("string")).alias("reason"))
    by_deny = denied.select(*own, "package", F.lit(1).alias("o"), F.concat(F.lit("denied capability "), F.col("capability"), F.lit(" in package "), F.col("package").cast("string")).alias("reason"))
    first = F.min(F.struct("package", "o", "reason"))
    return by_score.unionByName(by_deny).groupBy(*own).agg(F.count("*").alias("n_failing"), first.alias("f")).select(*own, (F.col("n_failing") == 0).alias("passed"), "n_failing", F.coalesce("f.reason", F.lit("")).alias("reason"))


def health_gate(health: DataFrame, least: int = 0, block_archived: bool = False) -> DataFrame:
    """module, reason: modules (module, score, archived) that are archived, or whose health is below ``least``."""
    archived = F.coalesce("archived", F.lit(False)) & F.lit(block_archived)
    low = (F.lit(least) > 0) & (F.col("score") < least)
    name = F.col("module").cast("string")
    reason = F.when(archived, F.concat(F.lit("module "), name, F.lit(" is archived"))).when(low, F.concat(F.lit("module "), name, F.lit(" has health "), F.col("score").cast("string"), F.lit(f", below {least}")))
    return health.select("module", reason.alias("reason")).filter("reason IS NOT NULL")


def gated_by_health(verdicts: DataFrame, failing: DataFrame) -> DataFrame:
    """Verdicts (project, passed, n_failing, reason) of which those that passed fail at the first failing module (project, module, reason)."""
    first = failing.groupBy("project").agg(F.count("*").alias("__n"), F.min(F.struct("module", "reason"))["reason"].alias("__reason"))
    both = verdicts.join(first, "project", "left")
    fails = F.col("passed") & F.col("__n").isNotNull()
    return both.select("project", (F.col("passed") & ~fails).alias("passed"), F.when(fails, F.col("__n")).otherwise(F.col("n_failing")).alias("n_failing"), F.when(fails, F.col("__reason")).otherwise(F.col("reason")).alias("reason"))
