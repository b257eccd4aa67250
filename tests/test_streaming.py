"""Streaming jobs give what their batch twins give."""

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.operators import activity
from tessera.streaming import jobs

SF = "/root/testdata/sf0.001"


def events(spark, stream):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet") if stream else spark.read
    return reader.parquet(SF if stream else f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(df, mode):
    name = "t" + uuid.uuid4().hex
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-stream-")).start()
    assert query.awaitTermination(180)
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_tumbling_counts(spark):
    assert run(jobs.tumbling(events(spark, True)), "complete") == sorted(map(tuple, activity.tumbling(events(spark, False)).collect()))


def test_windows_that_are_over_come_in_append_mode(spark):
    got, all_of_them = run(jobs.tumbling(events(spark, True)), "append"), activity.tumbling(events(spark, False)).count()
    assert 0 < len(got) < all_of_them + 1


def test_limiter_keeps_one_of_each_key(spark):
    got = run(jobs.deduplicated(events(spark, True), ["event_type"], "60 days"), "append")
    assert len(got) == events(spark, False).select("event_type").distinct().count()


def test_gap_sessions_split_at_midnight_and_gaps(spark):
    rows = [(1, 7, "2024-01-01 22:00:00"), (2, 7, "2024-01-01 23:50:00"), (3, 7, "2024-01-02 00:10:00"), (4, 7, "2024-01-02 03:00:00"), (5, None, "2024-01-02 03:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r.user_id or 0, r.session, r.n) for r in activity.gap_sessions(df).collect()) == [(0, 1, 1), (7, 1, 2), (7, 2, 1), (7, 3, 1)]
