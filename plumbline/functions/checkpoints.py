"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder that all executors share.

    That folder is spark.checkpoint.dir; where it is unset and Spark runs in this
    process alone, one of our own. Spark's estimate of the size goes with the lineage:
    it would be multiplied by every join of every round, until the number itself fills
    the driver's memory. What is known of a shuffle at run time decides on joins then.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="plumbline-"))
    kept = df.checkpoint(eager=True)._jdf
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept.queryExecution().analyzed().rdd(), kept.schema(), False), session)
