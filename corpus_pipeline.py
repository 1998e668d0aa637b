"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, PII, source mixing.

Each stage takes the documents that the one before kept, and its decisions take
effect: rejected documents, all but one of each group of near copies, and documents
that hold benchmark passages go; identifiers are masked in the text; the mix is
selected from what is left. Nulls, empty texts, repeated rows and extra columns are
treated as the operators' docstrings say; an empty table stays empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, neardup, pii, quality, tokens
from plumbline.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept, fitted on the labelled ones among them."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near copies."""
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of 13 words or more with a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers masked in the text; n_chars follows the text."""
    out = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind)).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents selected for the sources' token budgets."""
    return mixing.mixed(docs, tokens.VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
]
#: None: no stage but decontamination can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = name.replace(" ", "_")
        docs = scratch.write(stage(spark, docs, sf_dir), table)
        if before:
            scratch.drop(before)
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
