"""Snapshot history as a stream: level counts per window, and changes against the module's last score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S

CHANGES = "module string, ts timestamp, old_score int, new_score int, change string"


def level_counts(snaps: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Modules by level in tumbling (or sliding) windows; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    level = S.risk_level(F.col("score"))
    counts = [F.count_if(level == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")]
    return snaps.withWatermark("ts", late).groupBy(w.alias("w")).agg(*counts).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "high", "medium", "low")


def churn(commits: DataFrame, days: int = 90, late: str = "1 day") -> DataFrame:
    """Commits in a window of days that slides by one day."""
    return commits.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "file").agg(F.approx_count_distinct("commit").alias("churn")).select(F.col("w.end").alias("until"), "file", "churn")


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    out = []
    for row in pd.concat(list(batches)).sort_values("ts").itertuples():
        kind = "added" if last is None else "escalated" if row.score > last else "improved" if row.score < last else "unchanged"
        out.append((key[0], row.ts, last, int(row.score), kind))
        last = int(row.score)
    state.update((last,))
    state.setTimeoutDuration(int(30 * 86_400_000))
    yield pd.DataFrame(out, columns=["module", "ts", "old_score", "new_score", "change"]).astype({"old_score": "Int32"})


def changes(snaps: DataFrame) -> DataFrame:
    """Each score of a module against the one before; what isn't seen for 30 days is forgotten."""
    rows = snaps.select(F.col("module").cast("string").alias("module"), "ts", F.col("score").cast("int").alias("score"))
    return rows.groupBy("module").applyInPandasWithState(_change, CHANGES, "score int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: a time-limited cache as a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
