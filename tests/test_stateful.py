"""Stateful streams against their batch twins, transcripts, and order-dependent queries against folds in plain Python."""

import json
import tempfile
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import activity, feedback, insight, upkeep, vectors
from tessera.plans import catalog
from tessera.sources import transcripts
from tessera.sources.fixtures import Memory
from tessera.streaming import stateful

SF = "/root/testdata/sf0.001"


def streamed(spark, df, make):
    """All rows of a stream over two files of df, dealt by their order, one file a batch."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    rows = df.collect()
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in-{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")
    name = "t" + uuid.uuid4().hex
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/check").start()
    assert query.awaitTermination(180)
    return spark.table(name)


def test_segments(spark):
    m = Memory(spark, SF)
    used = m.accesses.join(m.vectors, F.col("node_id") == F.col("id"))
    rows = used.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("position"), "embedding").orderBy("position").limit(200)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    want = sorted(map(tuple, vectors.segments(rows, 0.2).collect()))
    assert sorted(map(tuple, streamed(spark, rows, lambda s: stateful.segments(s, 0.2)).collect())) == want and len({x[2] for x in want}) > 1


def test_heartbeats(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").orderBy("ts", "event_id")
    batch = activity.since_mark(events, F.col("event_type") == "error")
    want = {(r.event_id, int(r.since)) for r in batch.collect()}
    assert {(r.event_id, r.since) for r in streamed(spark, events, stateful.heartbeats).collect()} == want


def test_recall_states(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role").orderBy("turn", "conv_id")
    place = {"LOGGED": 0, "RESPONSE": 1, "FEEDBACK": 2}
    last = {}
    for r in streamed(spark, turns, stateful.recall_updates).collect():
        last[r.conv_id, r.turn] = max(last.get((r.conv_id, r.turn), 0), place[r.state])
    assert last == {(r.conv_id, r.turn): place[r.state] for r in feedback.recall_states(turns).collect()}


def test_limiter(spark):
    rows = [("a" if i % 3 else "b", i, f"2024-01-01 00:{i // 4:02d}:{i % 4 * 10:02d}") for i in range(80)]
    df = spark.createDataFrame(rows, "source string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    passed = Counter(r.source for r in streamed(spark, df, lambda s: stateful.limited(s, per_source=3, minutes=10)).collect() if r.passed)
    assert passed == {"a": 6, "b": 6}


def test_transcripts(spark):
    lines = [
        {"type": "user", "timestamp": "2024-01-01T10:00:00Z", "message": {"content": "hello"}},
        {"type": "assistant", "timestamp": "2024-01-01T10:01:00Z", "message": {"content": [{"type": "text", "text": "compact now"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a/b.py"}}]}},
        {"type": "system", "timestamp": "2024-01-01T10:02:00Z", "message": {"content": "x"}},
        {"type": "user", "timestamp": "2024-01-01T10:03:00Z", "message": {"content": "after"}},
    ]
    folder = tempfile.mkdtemp(prefix="spark-lines-")
    with open(f"{folder}/t.jsonl", "w") as f:
        f.write("\n".join([*map(json.dumps, lines), "{broken", ""]))
    got = transcripts.read(spark, folder)
    assert [(r.kind, r.texts, [(t.name, t.target) for t in r.tools]) for r in got.orderBy("ts").collect()] == [("user", ["hello"], []), ("assistant", ["compact now"], [("Edit", "a/b.py")]), ("user", ["after"], [])]
    assert [r.texts for r in transcripts.since_marker(got).collect()] == [["after"]]
    assert transcripts.newest_file(spark, folder).first().file.endswith("t.jsonl")
    transcripts.append(got.select("kind", "ts"), f"{folder}/log")
    assert transcripts.trim(spark, f"{folder}/log", F.lit("2024-01-01").cast("date")).count() == 3
    blobs = spark.createDataFrame([(1, bytearray(np.array([1, 2.5], "<f4").tobytes())), (2, None)], "id long, embedding binary")
    assert [r.embedding for r in transcripts.vectors_of(blobs).orderBy("id").collect()] == [[1.0, 2.5], None]


def test_greedy_clusters_equal_a_fold(spark):
    rows = catalog.QUERIES["q_greedy_clusters"](spark, SF).collect()
    live = Memory(spark, SF)
    nodes = live.bare_nodes.filter("locked and not archived").join(live.vectors.select("id", "embedding"), "id").collect()
    want, groups = set(), {}
    for n in nodes:
        groups.setdefault(n.project, []).append((n.id, np.array(n.embedding, np.float64)))
    for group, members in groups.items():
        members.sort(key=lambda x: x[0])
        free = dict(members)
        while free:
            seed = min(free)
            near = [i for i, v in free.items() if i == seed or v @ free[seed] > 0.1]
            want |= {(group, seed, i) for i in near} if len(near) >= 2 else set()
            for i in near:
                del free[i]
    assert rows and {(r.group, r.cluster, r.id) for r in rows} == want


def test_sentences_and_identifiers(spark):
    df = spark.createDataFrame([("Dr. Lee met us. It went well! See e.g. the notes? 3 items left.", "parseHTTPResponse2 and my_snake_name plus a.dotted.name")], "a string, b string")
    r = df.select(text.sentences(F.col("a")).alias("s"), text.domain_terms(F.col("b")).alias("t"), text.identifier_parts(F.lit("parseHTTPResponse")).alias("p")).first()
    assert r.s == ["Dr. Lee met us.", "It went well!", "See e.g. the notes?", "3 items left."]
    assert {"my_snake_name", "a.dotted.name"} <= set(r.t) and r.p == ["parse", "http", "response"]


def test_walks_take_edges(spark):
    from tessera.plans import network

    m = Memory(spark, SF)
    known = {(r.source_id, r.target_id) for r in network.edges(m).collect()}
    walks = catalog.QUERIES["q_random_walks"](spark, SF).collect()
    assert walks and all((a, b) in known for r in walks for a, b in zip(r.path, r.path[1:]))
    assert sorted(map(tuple, walks)) == sorted(map(tuple, catalog.QUERIES["q_random_walks"](spark, SF).collect()))


def test_risks(spark):
    rows = [(1, "please run git reset --hard on the ledger"), (2, "rm -rf build"), (3, "just read the ledger"), (4, None)]
    hot = spark.createDataFrame([("ledger",)], "w string")
    got = {r.id: r.risk for r in upkeep.risk(spark.createDataFrame(rows, "id long, text string").fillna(""), hot).collect()}
    assert got == {1: "high", 2: "low", 3: "none", 4: "none"}


@pytest.mark.parametrize("short", [False, True])
def test_containment(spark, short):
    items = [(1, "b c" if short else "bb cc dd ee ff"), (2, "zz yy" if short else "zz yy xx ww vv")]
    texts = spark.createDataFrame([("a B c d aa BB cc dd ee ffx",), ("nothing",), (None,)], "content string")
    left = upkeep.not_contained(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", texts, "content")
    assert [r.item_id for r in left.collect()] == [2]


def test_drain_gives_each_row_once(spark):
    rows, mark, seen = spark.range(25).withColumnRenamed("id", "k"), -1, []
    while batch := [r.k for r in insight.drained(rows, "k", mark, 10).collect()]:
        seen, mark = seen + batch, batch[-1]
    assert seen == list(range(25))
