"""Activity over time: gap sessions, counts in windows, running counters, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str = "user_id", gap_hours: float = 2.0, order: str = "event_id") -> DataFrame:
    """key, session (from 1), started, ended, n: a new session after a gap, or on another day.

    The window is by key and day, as no session spans midnight, so a busy key is dealt out over its days.
    """
    daily = Window.partitionBy(key, "day").orderBy("ts", order)
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(daily), F.col("ts")) > gap_hours * 3.6e9
    marked = events.withColumn("day", F.to_date("ts")).withColumn("opens", F.when(gap, 1).otherwise(0))
    marked = marked.withColumn("part", F.sum("opens").over(daily.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.groupBy(key, "day", "part").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return each.withColumn("session", F.row_number().over(Window.partitionBy(key).orderBy("started", "part"))).select(key, "session", "started", "ended", "n")


def tumbling(events: DataFrame, length: str = "30 minutes") -> DataFrame:
    """started, n, errors of each window; the same columns serve batch and stream."""
    counted = events.groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counted.select(F.col("window.start").alias("started"), "n", "errors")


def since_mark(events: DataFrame, mark, key: str = "user_id") -> DataFrame:
    """events with since: how many of the key's events, this one included, came after its last marked one."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_block", F.sum(F.when(mark, 1).otherwise(0)).over(order))
    within = Window.partitionBy(key, "_block").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("since", F.sum(F.when(mark, 0).otherwise(1)).over(within)).drop("_block")


def budgets(windows: DataFrame, order: str, total: int) -> DataFrame:
    """windows with weight (1, .7, .5, then .25, by distance from the last) and budget (its share of total, whole).

    windows: a bounded report, one row a window.
    """
    place = F.row_number().over(Window.orderBy(F.desc(order)))
    weighed = windows.withColumn("weight", F.when(place == 1, 1.0).when(place == 2, 0.7).when(place == 3, 0.5).otherwise(0.25))
    everything = weighed.agg(F.sum("weight").alias("_all"))
    return weighed.crossJoin(F.broadcast(everything)).withColumn("budget", F.floor(total * F.col("weight") / F.col("_all") + 1e-9)).drop("_all")
