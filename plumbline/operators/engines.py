"""Project engines: topology, integrity, licences, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import RISKY_LICENSES


def topology_metrics(depths: DataFrame, direct: DataFrame, versions: DataFrame, churn: int = -1) -> DataFrame:
    """One row: direct, total, max_depth, deep_pct (depth 4 or more), skew, duplicates, churn.

    ``depths`` (package, depth), ``direct`` (package), ``versions`` (base, version). Where all three have a
    project, it is a row per project.
    """
    if all("project" in t.columns for t in (depths, direct, versions)):
        some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        d = depths.groupBy("project").agg(F.count("*").alias("total"), F.max("depth").alias("max_depth"), F.avg(F.when(F.col("depth") >= 4, 100.0).otherwise(0.0)).alias("deep_pct"))
        per = versions.groupBy("project", "base").agg(F.count_distinct("version").alias("n"))
        v = per.groupBy("project").agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.max("n").alias("skew"))
        n = direct.groupBy("project").agg(F.count_distinct("package").alias("direct"))
        out = n.join(d, "project", "full_outer").join(v, "project", "full_outer")
        return out.select("project", *[some(F.col(c)).alias(c) for c in ("direct", "total", "max_depth")], F.coalesce("deep_pct", F.lit(0.0)).alias("deep_pct"), *[some(F.col(c)).alias(c) for c in ("skew", "duplicates")], F.lit(churn).cast("long").alias("churn"))
    d = depths.agg(F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.coalesce(F.avg(F.when(F.col("depth") >= 4, 100.0).otherwise(0.0)), F.lit(0.0)).alias("deep_pct"))
    per = versions.groupBy("base").agg(F.count_distinct("version").alias("n"))
    v = per.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.coalesce(F.max("n"), F.lit(0)).alias("skew"))
    return direct.agg(F.count_distinct("package").alias("direct")).crossJoin(d).crossJoin(v).withColumn("churn", F.lit(churn).cast("long"))


def topology_signals(metrics: DataFrame) -> DataFrame:
    """signal, value, points: five rows, of each project where there is one."""
    c = lambda n: F.col(n).cast("double")
    banded = {
        "direct": S.banded(F.col("direct"), (">", 100, 8), (">=", 50, 5), (">=", 20, 2)),
        "deep_pct": S.banded(F.col("deep_pct"), (">", 60, 5), (">=", 30, 2)),
        "skew": S.banded(F.col("skew"), (">", 8, 3), (">=", 3, 2)),
        "duplicates": S.banded(F.col("duplicates"), (">", 10, 3), (">=", 3, 2)),
        "churn": S.banded(F.col("churn"), (">", 10, 4), (">=", 3, 2)),
    }
    own = [c for c in ("project",) if c in metrics.columns]
    return metrics.select(*own, F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), c(k).alias("value"), v.cast("long").alias("points")) for k, v in banded.items()])).alias("s")).select(*own, "s.*")


def capped(points: DataFrame, column: str = "points", cap: int = 20) -> DataFrame:
    return points.agg(F.least(F.lit(cap), F.coalesce(F.sum(column), F.lit(0))).cast("long").alias("score"))


def npm_integrity(packages: DataFrame, budget: int = 10) -> DataFrame:
    """Violations of a lockfile: (package, type, points).

    missing_integrity costs 2, up to ``budget`` points in all in the order of names;
    path_dep 5, git_dep 8. The running sum is over the lockfile's missing rows only.
    """
    resolved = F.coalesce("resolved", F.lit(""))
    path = F.startswith(resolved, F.lit("file:")) | F.startswith(resolved, F.lit("link:"))
    git = F.startswith(resolved, F.lit("git+")) | F.startswith(resolved, F.lit("git:")) | F.startswith(resolved, F.lit("github:"))
    missing = packages.filter((F.coalesce("integrity", F.lit("")) == "") & ~path & ~git)
    run = F.sum(F.lit(2)).over(Window.partitionBy("project").orderBy("package").rowsBetween(Window.unboundedPreceding, 0))
    spent = missing.withColumn("__sum", run).select("project", "package", F.lit("missing_integrity").alias("type"), F.when(F.col("__sum") <= budget, 2).otherwise(0).alias("points"))
    kind = lambda cond, name, points: packages.filter(cond).select("project", "package", F.lit(name).alias("type"), F.lit(points).alias("points"))
    return spent.unionByName(kind(path, "path_dep", 5)).unionByName(kind(git, "git_dep", 8))


def go_integrity(requires: DataFrame, sums: DataFrame, replaces: DataFrame) -> DataFrame:
    """missing_checksum 5; a replacement costs 8 where it mentions git, else 6 where it is a path.

    Where the tables have a project, sums cover the requires of their own project only.
    """
    own = [c for c in ("project", "package") if all(c in t.columns for t in (requires, sums, replaces))]
    missing = requires.join(sums.select(own).distinct(), own, "left_anti").select(*own, F.lit("missing_checksum").alias("type"), F.lit(5).alias("points"))
    git = F.contains("target", F.lit("git"))
    local = F.startswith("target", F.lit("./")) | F.startswith("target", F.lit("../")) | F.startswith("target", F.lit("/"))
    kind = F.when(git, F.struct(F.lit("git_replace").alias("type"), F.lit(8).alias("points"))).when(local, F.struct(F.lit("local_replace").alias("type"), F.lit(6).alias("points")))
    return missing.unionByName(replaces.withColumn("k", kind).filter("k IS NOT NULL").select(*own, "k.type", "k.points"))


def coverage(requires: DataFrame, sums: DataFrame) -> DataFrame:
    """total, covered, pct."""
    have = sums.select("package").distinct().withColumn("__in", F.lit(1))
    out = requires.join(have, "package", "left").agg(F.count("*").alias("total"), F.count("__in").alias("covered"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(100.0))


def license_risk(modules: DataFrame, licenses: DataFrame) -> DataFrame:
    """module, license, risky, reason; an unknown licence is risky."""
    lic = F.coalesce("license", F.lit("unknown"))
    risky = lic.isin(*RISKY_LICENSES) | (lic == "unknown")
    reason = F.when(lic == "unknown", "license unknown").when(risky, F.concat(F.lit("copyleft license: "), F.when(lic == "CCDL-1.0", "CDDL-1.0").otherwise(lic))).otherwise("")
    return modules.join(licenses, "module", "left").select("module", lic.alias("license"), risky.alias("risky"), reason.alias("reason"))


def health(modules: DataFrame, repos: DataFrame, releases: DataFrame, vulns: DataFrame, today) -> DataFrame:
    """Health score 0..100 and its signals, from tables of repositories, releases and vulnerabilities."""
    rel = releases.groupBy("module").agg(F.count("*").alias("n_rel"))
    vul = vulns.groupBy("module").agg(F.count("*").alias("n_cve"))
    all_ = modules.join(repos, "module", "left").join(rel, "module", "left").join(vul, "module", "left")
    known = F.col("pushed").isNotNull()
    age = F.datediff(today, F.col("pushed"))
    archived = F.when(F.col("archived"), -50).otherwise(0)
    aged = F.when(~known, 0).when(age > 730, -30).when(age > 365, -15).when(age > 180, -5).otherwise(0)
    n = F.coalesce("n_rel", F.lit(0))
    bonus = F.when(~known, 0).when(n >= 5, 15).when(n >= 2, 8).when(n == 1, 3).otherwise(0)
    cve = -30 * F.coalesce("n_cve", F.lit(0))
    all_ = all_.withColumns({"archived_points": archived, "age_points": aged, "release_points": bonus, "cve_points": cve.cast("int")})
    total = F.lit(100) + F.col("archived_points") + F.col("age_points") + F.col("release_points") + F.col("cve_points")
    return all_.select("module", F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int").alias("score"), "archived_points", "age_points", "release_points", "cve_points")


def churn(commits: DataFrame, now, days: int = 90) -> DataFrame:
    """Distinct commits of the last days; -1 where there is no history at all."""
    recent = F.count_distinct(F.when(F.col("ts") >= F.date_sub(now, days), F.col("commit")))
    return commits.agg(F.when(F.count("*") > 0, recent).otherwise(-1).alias("churn"))
