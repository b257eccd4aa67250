"""Limits over all sources, look-backs, late rows and idle upkeep, over streams of several batches."""

import datetime as dt
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.streaming import jobs, limits, maintenance

START = dt.datetime(2024, 1, 1)


def files(spark, rows, schema, parts):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{folder}/in-{i}")
    return folder


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def finished(df, sink=None):
    name, check = "t" + uuid.uuid4().hex, tempfile.mkdtemp(prefix="spark-stream-")
    writer = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", check)
    query = writer.format("parquet").start(sink) if sink else writer.format("memory").queryName(name).start()
    assert query.awaitTermination(180)
    return df.sparkSession.read.parquet(sink) if sink else df.sparkSession.table(name)


ERRORS = "source string, event_id long, ts timestamp, mark string"


def plain(rows, lim):
    """Verdicts of errors one after another, each source by itself, then all together."""
    sources, verdicts, seen, allowed = {}, {}, [], {}
    for source, event, ts, mark in rows:
        now = ts.timestamp()
        verdicts[event] = sources.setdefault(source, limits.Source(lim)).judge(now, mark)
        if verdicts[event] == "passed":
            seen = [t for t in seen if t > now - lim.stretch]
            allowed[event] = len(seen) < lim.together
            seen += [now] * allowed[event]
    return verdicts, allowed


def both(spark, rows, lim, parts=2):
    first = finished(limits.by_source(stream(spark, files(spark, rows, ERRORS, parts), ERRORS), lim), tempfile.mkdtemp(prefix="spark-stream-") + "/in-passed")
    verdicts = {r.event_id: r.verdict for r in first.collect()}
    passed = [(r.source, r.event_id, r.ts) for r in first.filter("verdict = 'passed'").orderBy("ts", "event_id").collect()]
    shape = "source string, event_id long, ts timestamp"
    return verdicts, {r.event_id: r.allowed for r in finished(limits.together(stream(spark, files(spark, passed, shape, parts), shape), lim)).collect()}


def test_many_sources_open_the_global_limit(spark):
    """Sixty errors of twenty sources, three each: no source is over its limit, all of them together are."""
    rows = [(f"s{i % 20}", i, START + dt.timedelta(seconds=5 * i), f"m{i}") for i in range(60)]
    lim = limits.Limits(per_source=5, together=50)
    verdicts, allowed = both(spark, rows, lim)
    assert set(verdicts.values()) == {"passed"} and [allowed[i] for i in range(60)] == [True] * 50 + [False] * 10


def test_limits_equal_one_error_after_another(spark):
    rng, at, rows = random.Random(4), 0.0, []
    for i in range(400):
        at += rng.choice([0.5, 3.0, 40.0])
        rows.append((rng.choice(["flood"] * 6 + ["a", "b"]), i, START + dt.timedelta(seconds=at), f"m{rng.randrange(60)}"))
    lim = limits.Limits(per_source=8, together=14, stretch=300.0, repeats=20.0, shut=120.0)
    want = plain(rows, lim)
    assert set(want[0].values()) == {"passed", "repeat", "limited", "shut"} and len(set(want[1].values())) == 2
    assert both(spark, rows, lim, 3) == want


def test_state_of_a_source_ends(spark):
    """A source that was shut out long ago starts anew, though its state was dropped by the timer meanwhile."""
    lim = limits.Limits(per_source=2, together=99, stretch=100.0, repeats=1.0, shut=50.0)
    rows = [("a", i, START + dt.timedelta(seconds=2 * i), f"m{i}") for i in range(6)] + [("b", 10 + i, START + dt.timedelta(hours=2 + i), "x") for i in range(4)] + [("a", 20, START + dt.timedelta(hours=9), "y")]
    assert both(spark, rows, lim, 11)[0] == plain(rows, lim)[0]


EVENTS = "event_id long, ts timestamp, user_id long"


def test_look_backs_equal_the_batch(spark):
    rng = random.Random(2)
    rows = sorted((i, START + dt.timedelta(minutes=rng.randrange(4000)), i % 3) for i in range(200))
    rows.sort(key=lambda r: r[1])
    rows += [(999, START + dt.timedelta(days=30), 0)]
    got = {(r.ended, r.user_id): r.n for r in finished(jobs.look_backs(stream(spark, files(spark, rows, EVENTS, 3), EVENTS), "24 hours", "6 hours", ["user_id"])).collect()}
    want = {}
    for _, ts, user in rows[:-1]:
        end = START + dt.timedelta(hours=6 * ((ts - START) // dt.timedelta(hours=6) + 1))
        for k in range(4):
            key = (end + dt.timedelta(hours=6 * k), user)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_late_rows_go_to_a_table_of_their_own(spark):
    rows = [(i, START + dt.timedelta(minutes=i), 0) for i in range(10)] + [(10, START, 0), (11, START + dt.timedelta(minutes=5), 0), (12, None, 0), (13, START + dt.timedelta(minutes=20), 0)]
    source, folder = files(spark, rows, EVENTS, 2), tempfile.mkdtemp(prefix="spark-stream-")
    for _ in range(2):  # the second run has nothing to do
        assert jobs.with_late_rows(stream(spark, source, EVENTS), folder, "2 minutes").awaitTermination(120)
    ids = lambda kind: sorted(r.event_id for r in spark.read.parquet(f"{folder}/{kind}").collect())
    assert ids("late") == [10] and ids("on_time") == [*range(10), 11, 12, 13]


NODES = "id long, content string, summary string, locked boolean, archived boolean, stability double, access_count long, last_accessed timestamp, created_at timestamp, embedding array<double>"


@pytest.fixture()
def store(spark):
    long = "A first sentence that says what it is about. " + "More words follow after it. " * 5
    near = [[1.0, 0.0], [0.99, 0.1411], [0.0, 1.0], [0.6, 0.8], None]
    nodes = [(i, long, None if i else "has one", i < 3, False, 4.0, 8 if i == 3 else 1, None, START + dt.timedelta(days=i), near[i]) for i in range(5)]
    folder = tempfile.mkdtemp(prefix="spark-store-")
    edges = spark.createDataFrame([(0, 2, 0.5), (1, 3, 0.4), (3, 4, 0.01), (0, 1, 0.9)], "source_id long, target_id long, weight double")
    maintenance.begin(folder, spark.createDataFrame(nodes, NODES), edges)
    return folder


def tables(spark, store, n):
    return [sorted(map(repr, maintenance.version(spark, store, t, n).collect())) for t in maintenance.TABLES]


def test_idle_upkeep_in_order(spark, store):
    """Accesses come in two batches. Locks see the counts of the batch, merges the embeddings, summaries what is left; a second run changes nothing, a repeated batch neither."""
    shape = "node_id long, ts timestamp"
    rows = [(3, START + dt.timedelta(days=40))] * 3 + [(4, START + dt.timedelta(days=41)), (0, START + dt.timedelta(days=41)), (77, START)]
    source = files(spark, rows, shape, 2)
    assert maintenance.run(stream(spark, source, shape), store) == 2
    after = {r.id: r for r in maintenance.version(spark, store, "nodes", 2).collect()}
    assert after[3].access_count == 11 and after[3].stability == 6.0 and after[3].locked and after[3].last_accessed == START + dt.timedelta(days=40)
    assert after[0].archived and not after[1].archived and after[0].access_count == 2  # node 1 is newer; it took over what node 0 had when it was merged
    assert after[1].access_count == 2 and after[4].summary == "A first sentence that says what it is about." and after[0].summary == "has one"
    assert {(r.source_id, r.target_id): r.weight for r in maintenance.version(spark, store, "edges", 2).collect()} == {(1, 2): 0.5, (1, 3): 0.4}
    assert {r.step: r.changed for r in maintenance.version(spark, store, "log", 1).collect()} == {"used": 1, "merged": 1, "locked": 1, "summarised": 4}
    done = [tables(spark, store, n) for n in (1, 2)]
    maintenance.run(stream(spark, source, shape), store)
    assert [tables(spark, store, n) for n in (1, 2)] == done
    nodes, edges, log = maintenance.tended(maintenance.version(spark, store, "nodes", 1), maintenance.version(spark, store, "edges", 1), spark.createDataFrame(rows[3:], shape))
    assert [sorted(map(repr, df.collect())) for df in (nodes, edges, log)] == done[1]
