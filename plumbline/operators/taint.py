"""Source-to-sink pairs within a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import TAINT_RULES


def rules(spark: SparkSession) -> DataFrame:
    """The 13 rules."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(TAINT_RULES)], "rule int, source string, sink string, risk string, note string")


def pairs(per_cap: DataFrame) -> DataFrame:
    """package, source, sink, risk, note, confidence: packages that have both ends of a rule.

    The rules are a constant table of 13 rows and are broadcast; the two sides of the
    join share their partitioning by package.
    """
    r = F.broadcast(rules(per_cap.sparkSession))
    src = per_cap.select("package", F.col("capability").alias("source"), F.col("confidence").alias("source_conf"))
    snk = per_cap.select("package", F.col("capability").alias("sink"), F.col("confidence").alias("sink_conf"))
    found = src.join(r, "source").join(snk, ["package", "sink"])
    conf = F.least("source_conf", "sink_conf")
    return found.select("package", "source", "sink", F.col("risk").alias("rule_risk"), S.downgrade(F.col("risk"), conf).alias("risk"), "note", conf.alias("confidence"), "source_conf", "sink_conf")


def keep_confident(findings: DataFrame, least: float) -> DataFrame:
    """Findings of at least this confidence; 0 or less keeps all."""
    return findings.filter(F.col("confidence") >= least) if least > 0 else findings


def suppressed(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Findings less those excepted by (package, source, sink)."""
    return findings.join(exceptions.select("package", "source", "sink"), ["package", "source", "sink"], "left_anti")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("package").agg(F.count("*").alias("n"), F.count_if(F.col("risk") == "HIGH").alias("high"), F.count_if(F.col("risk") == "MEDIUM").alias("medium"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(S.risk_value(F.col("risk"))), "package", "source", "sink")


def first_of_each(findings: DataFrame, tie: str = "package") -> DataFrame:
    """The gravest finding per package, source and sink."""
    w = Window.partitionBy("package", "source", "sink").orderBy(F.desc(S.risk_value(F.col("risk"))), tie)
    return findings.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
