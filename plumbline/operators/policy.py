"""Policy: exclusions, exceptions with expiry, deny lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def excluded(rows: DataFrame, patterns: DataFrame, name: str = "name") -> DataFrame:
    """Rows that match no pattern (x, or x/* for x and all below).

    Patterns without a wildcard, and the prefixes of wildcards, are joined by equality
    with the name's own path prefixes, so the cost doesn't grow with the product of the two.
    """
    wild = patterns.filter(F.endswith("pattern", F.lit("/*"))).select(F.regexp_replace("pattern", r"/\*$", "").alias("__p"), F.lit(True).alias("__w"))
    exact = patterns.filter(~F.endswith("pattern", F.lit("/*"))).select(F.col("pattern").alias("__p"), F.lit(False).alias("__w"))
    keys = wild.unionByName(exact).distinct()
    hit = rows.select(name).distinct().withColumn("__p", F.explode(S.prefixes(F.col(name), "/"))).join(keys, "__p").filter(F.col("__w") | (F.col("__p") == F.col(name))).select(F.col(name).alias("__n")).distinct()
    return rows.join(hit, rows[name] == hit["__n"], "left_anti")


def suppressed_modules(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows whose module, or else whose package, matches no pattern (those of ``suppress.by_module``)."""
    named = rows.withColumn("__subject", F.coalesce(F.col("module").cast("string"), F.col("package").cast("string")))
    return excluded(named, patterns, "__subject").drop("__subject")


def in_focus(rows: DataFrame, focus: str, *names: str) -> DataFrame:
    """Rows one of whose names is the focus or below it."""
    keep = F.lit(False)
    for n in names:
        keep = keep | S.under(F.col(n), F.lit(focus))
    return rows.filter(keep)


def expired(expires: Column, now: Column) -> Column:
    """null where the date can't be read; the day itself is still good until it begins."""
    return now > F.try_to_timestamp(expires, F.lit("yyyy-MM-dd"))


def active(exceptions: DataFrame, now: Column) -> DataFrame:
    """Exceptions without expiry, or with a readable one in the future."""
    return exceptions.filter(F.col("expires").isNull() | (F.col("expires") == "") | ~expired(F.col("expires"), now))


def stats(exceptions: DataFrame, now: Column) -> DataFrame:
    """applied, expired and taint exceptions."""
    given = F.col("expires").isNotNull() & (F.col("expires") != "")
    old = given & expired(F.col("expires"), now)
    bad = given & expired(F.col("expires"), now).isNull()
    return exceptions.agg(F.count_if(~F.coalesce(old, F.lit(False)) & ~bad).alias("applied"), F.count_if(old).alias("expired"), F.count_if(bad).alias("unreadable"), F.count_if(F.col("taint").isNotNull()).alias("taint"))


def denied(per_cap: DataFrame, deny: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(package, capability) on the deny list and not excepted."""
    return per_cap.join(F.broadcast(deny), "capability", "left_semi").join(exceptions.select("package", "capability"), ["package", "capability"], "left_anti").select("package", "capability")
