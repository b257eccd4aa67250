"""Streaming twins of the activity operators: the same columns under watermarks.

`events` is a streaming DataFrame with event_id, ts (timestamp), user_id, event_type; late rows beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import activity

LATENESS = "10 minutes"


def tumbling(events: DataFrame, length: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Counts of each window; in append mode a window is given once the watermark has passed it."""
    return activity.tumbling(events.withWatermark("ts", lateness), length)


def sessions(events: DataFrame, gap: str = "2 hours", lateness: str = LATENESS) -> DataFrame:
    """user_id, started, ended (last event plus gap), n of gap sessions, split at midnight."""
    grouped = events.withWatermark("ts", lateness).groupBy("user_id", F.to_date("ts").alias("day"), F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """The first event of each key within the watermark's span: an error limiter."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def look_backs(events: DataFrame, length: str, step: str, by: list[str], lateness: str = LATENESS) -> DataFrame:
    """ended, by, n: events of the last stretch of this length before each step; a look-back is given once the watermark has passed its end."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", length, step), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("ended"), *by, "n")


def with_late_rows(events: DataFrame, folder: str, lateness: str = LATENESS):
    """A query that writes events as they come to folder/on_time, and those that are late against all batches before to folder/late.

    Each batch writes folders of its own, so a repeated batch writes them again; the mark is the latest time of earlier batches' folders.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        earlier = [f"{folder}/on_time/batch={i}" for i in range(n)]
        mark = spark.read.schema(batch.schema).parquet(*earlier).agg(F.max("ts")).first()[0] if earlier else None
        late = F.lit(False) if mark is None else F.coalesce(F.col("ts") < F.lit(mark) - F.expr(f"interval {lateness}"), F.lit(False))
        batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/on_time/batch={n}")
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={n}")

    return events.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
