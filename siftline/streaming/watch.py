"""Change events as a stream: the last event of each path, batches small enough to apply alone, sessions with a quiet end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FULL_ABOVE = 40


def compact(events: DataFrame) -> DataFrame:
    """events(seq, repo_id, type, path) -> the last type of each path: upsert or delete."""
    last = F.max_by("type", "seq")
    return events.groupBy("repo_id", "path").agg(F.when(last == "delete", "delete").otherwise("upsert").alias("action"))


def plan(events: DataFrame) -> DataFrame:
    """(repo_id, mode, upserts, deletes): full above FULL_ABOVE paths or when ignore rules changed, else partial."""
    counts = compact(events).groupBy("repo_id").agg(
        F.count(F.when(F.col("action") == "upsert", 1)).alias("upserts"), F.count(F.when(F.col("action") == "delete", 1)).alias("deletes"), F.max(F.col("path").rlike(r"(^|/)\.gitignore$")).alias("rules")
    )
    return counts.select("repo_id", F.when((F.col("upserts") + F.col("deletes") > FULL_ABOVE) | F.col("rules"), "full").otherwise("partial").alias("mode"), "upserts", "deletes")


def quiet_sessions(events: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Bursts of events(ts, repo_id, …) that end after a quiet time; works on a stream and on a table alike."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        marked = marked.withWatermark("ts", delay)
    return marked.groupBy("repo_id", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("events")).select("repo_id", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "events")


def apply_stream(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Start a query that hands every micro-batch, compacted, to apply(actions, batch_id)."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: apply(compact(batch), n)).start()
