"""Event streams: latest votes, play counters, new sidecar files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_votes(events: DataFrame) -> DataFrame:
    """(item_id, vote, voted_at) in update mode; events: ts, event_id, user_id, event_type."""
    e = events.filter(F.col("event_type").isin("purchase", "error"))
    vote = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return e.groupBy(F.col("user_id").alias("item_id")).agg(F.max_by(vote, F.struct("ts", "event_id")).alias("vote"), F.max("ts").alias("voted_at"))


def play_counts(events: DataFrame, window: str | None = None, late: str = "1 day") -> DataFrame:
    """(item_id, play_count, played_at), by event-time window if one is given."""
    e = events.filter("event_type = 'view'")
    keys = [F.col("user_id").alias("item_id")]
    if window:
        e = e.withWatermark("ts", late)
        keys.insert(0, F.window("ts", window).alias("window"))
    return e.groupBy(*keys).agg(F.count("*").alias("play_count"), F.max("ts").alias("played_at"))


def upserting(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Run write(batch, id) for every micro-batch of files that are new; modified files need the batch difference."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
