"""Extension: conversations from a live stream of events, by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "8 hours", lateness: str = "1 day") -> DataFrame:
    """user_id, session bounds, turns and labelled turns; late events beyond the
    watermark are dropped, as for any append-mode stream."""
    ts = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", ts).withWatermark("ts", lateness) if events.isStreaming else events.withColumn("ts", ts)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns"), F.count_if(F.col("event_type") != "error").alias("labelled"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "labelled")
