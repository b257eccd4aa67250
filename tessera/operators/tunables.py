"""Parameters that change: an append-only log of changes, its audit, and the values in force at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def audit(log: DataFrame) -> DataFrame:
    """key, old, new, at of every change in a log (key, value, at, seq); the first change of a key has no old value."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    return log.select("key", F.lag("value").over(order).alias("old"), F.col("value").alias("new"), "at")


def in_force(log: DataFrame) -> DataFrame:
    """key, value, low, high: what holds from low until before high (null: still); of changes at one time the last by seq holds."""
    last = log.groupBy("key", "at").agg(F.max_by("value", "seq").alias("value"))
    return last.select("key", "value", F.col("at").alias("low"), F.lead("at").over(Window.partitionBy("key").orderBy("at")).alias("high"))


#: Moments of one stretch of time, about, and the most stretches.
STRETCH, STRETCHES = 65536, 4096


def as_of(rows: DataFrame, at: str, log: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """rows with a column for each key of defaults: its value in force at the row's time, or the default where there was none or the time is null.

    The moments of rows and changes, each once, are dealt to stretches of time; a stretch carries its values forward in order, and starts with the last ones of the stretches before. So no
    row meets more than one moment, however many changes a day has. Rows are read twice.
    """
    names = [f"_{i}" for i in range(len(defaults))]
    of = lambda key: F.max(F.when(F.col("key") == key, F.struct("value")))  # noqa: E731  a struct, as a change to null is one too
    changes = log.filter(F.col("key").isin(*defaults)).groupBy("key", F.col("at").alias("_at")).agg(F.max_by("value", "seq").alias("value"))
    changes = changes.groupBy("_at").agg(*[of(key).alias(n) for key, n in zip(defaults, names)], F.lit(False).alias("_asked"))
    asked = rows.select(F.col(at).alias("_at"), F.lit(True).alias("_asked")).filter("_at is not null").distinct()
    every = changes.unionByName(asked, allowMissingColumns=True).groupBy("_at").agg(*[F.max(n).alias(n) for n in names], F.max("_asked").alias("_asked"))
    line = written(every.withColumn("_micros", F.unix_micros(F.col("_at").cast("timestamp"))), "moments")
    about = line.agg(F.min("_micros").alias("low"), F.max("_micros").alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, -(-((about.high or 0) - (about.low or 0) + 1) // min(STRETCHES, max(1, -(-about.n // STRETCH)))))
    line = line.withColumn("_part", F.floor((F.col("_micros") - F.lit(about.low or 0)) / F.lit(width)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = line.groupBy("_part").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_at"))).alias(n) for n in names])
    carried = ends.select("_part", *[F.last(n, ignorenulls=True).over(before).alias(f"{n}c") for n in names])
    held = line.withColumns({n: F.last(n, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) for n in names})
    held = held.filter("_asked").join(F.broadcast(carried), "_part").select("_at", *[F.coalesce(n, f"{n}c").alias(n) for n in names])
    met = rows.join(held, F.col(at) == F.col("_at"), "left")
    return met.withColumns({key: F.coalesce(F.col(n)["value"], F.lit(default)) for n, (key, default) in zip(names, defaults.items())}).drop("_at", *names)
