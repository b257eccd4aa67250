"""Parameters that change, running totals and keywords beyond a cap."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import graph, insight, tunables, upkeep

START = dt.datetime(2024, 1, 1)
LOG = "key string, value double, at timestamp_ntz, seq long"


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_scores_differ_by_the_logged_change(spark):
    log = spark.createDataFrame([("a", 0.5, at(10), 1), ("a", 0.7, at(10), 2), ("a", 0.9, at(60), 3), ("b", 2.0, at(-5), 4), ("c", 9.0, at(0), 5)], LOG)
    assert {(r.key, r.old, r.new) for r in tunables.audit(log).filter("key = 'a'").collect()} == {("a", None, 0.5), ("a", 0.5, 0.7), ("a", 0.7, 0.9)}
    rows = spark.createDataFrame([(i, at(h)) for i, h in enumerate((9, 10, 59.9, 60, 500))] + [(9, None)], "id long, moment timestamp_ntz")
    got = {r.id: (r.a, r.b) for r in tunables.as_of(rows, "moment", log, {"a": 0.1, "b": 1.0}).collect()}
    assert got == {0: (0.1, 2.0), 1: (0.7, 2.0), 2: (0.7, 2.0), 3: (0.9, 2.0), 4: (0.9, 2.0), 9: (0.1, 1.0)}
    assert [r.a for r in tunables.as_of(rows.limit(0), "moment", log, {"a": 0.1}).collect()] == []
    assert {r.a for r in tunables.as_of(rows, "moment", log.limit(0), {"a": 0.1}).collect()} == {0.1}


def test_running_totals_over_ranges(spark):
    rows = spark.createDataFrame([(i, i % 7, (i * 37) % 11) for i in range(500)], "id long, k long, size long").repartition(8)
    got = {r.id: r.filled for r in insight.running(rows, [F.desc("k"), F.col("id")], "size").collect()}
    total, want = 0, {}
    for i in sorted(range(500), key=lambda i: (-(i % 7), i)):
        total += (i * 37) % 11
        want[i] = total
    assert got == want


def test_critical_rows_beyond_any_number_stay(spark):
    rows = spark.createDataFrame([(i, i < 300, 10) for i in range(400)], "id long, critical boolean, size long")
    kept = insight.within_budget(rows, [F.desc("critical"), F.col("id")], "size", 50, F.col("critical")).collect()
    assert {r.id for r in kept} == set(range(300))


def test_more_accesses_at_one_time_than_are_looked_back_for(spark):
    """Sixty accesses share a moment; the three last before it are still found, and the three last of it afterwards."""
    rows = [(i, 1, 100 + i, at(0) + dt.timedelta(minutes=i)) for i in range(4)] + [(10 + i, 1, 200 + i, at(0.5)) for i in range(60)] + [(99, 1, 999, at(0.6))]
    got = upkeep.recent_before(spark.createDataFrame(rows, "event_id long, user_id long, node_id long, ts timestamp_ntz"), hours=1, k=3).collect()
    of = lambda e: sorted(r.target_id for r in got if r.event_id == e)
    assert of(40) == of(69) == [101, 102, 103] and of(99) == [257, 258, 259] and of(0) == []


def test_keywords_keep_names_and_numbers_before_words(spark):
    text = "zeta " + " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)) + " camelCase 5ms my_snake Proper.Name a.dotted 30%"
    r = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(insight.keywords(F.col("t")).alias("k")).collect()
    assert len(r[0].k) == 50 and r[0].k[:5] == ["case", "proper.name", "propername", "camelcase", "my_snake"] and {"a.dotted", "5ms", "30%", "zeta"} <= set(r[0].k) and r[1].k == []


def test_sessions_keep_their_most_used_nodes(spark):
    rows = [(1, "d", i, 1) for i in range(20)] + [(1, "d", 50, 9)]
    pairs = graph.co_access(spark.createDataFrame(rows, "user_id long, day string, node_id long, uses long")).collect()
    assert {x for r in pairs for x in (r.source_id, r.target_id)} == {*range(14), 50}


def test_items_in_texts(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon"), (2, "not there at all today"), (3, "gam"), (4, "missing"), (5, None)], "item long, text string")
    texts = spark.createDataFrame([(1, "xx ALPHA beta  gamma delta epsilonic"), (2, "xx alpha beta gamma delta epsilonic")], "id long, content string")
    assert sorted(r.item for r in upkeep.not_contained(items, "item", "text", texts, "content", key="id").collect()) == [2, 4, 5]


def test_a_day_of_many_changes_meets_no_row_whole(spark, monkeypatch):
    """Values as of times equal those of plain Python over several stretches; before, each row of a day was joined with an array of all its changes."""
    import bisect
    import random

    monkeypatch.setattr(tunables, "STRETCH", 50)
    rng = random.Random(3)
    log = [("a" if rng.random() < 0.6 else "b", None if i % 40 == 7 else float(i), at(rng.randrange(0, 400) / 20), i) for i in range(600)]
    rows = [(i, at(rng.randrange(-40, 500) / 20) if i % 30 else None) for i in range(300)] + [(1000 + i, at(3)) for i in range(200)]
    out = tunables.as_of(spark.createDataFrame(rows, "id long, moment timestamp_ntz"), "moment", spark.createDataFrame(log, LOG), {"a": -1.0, "b": -2.0})
    got = {r.id: (r.a, r.b) for r in out.collect()}
    for i, moment in rows:
        for key, default, value in (("a", -1.0, got[i][0]), ("b", -2.0, got[i][1])):
            changes = sorted((t, seq, v) for k, v, t, seq in log if k == key)
            n = bisect.bisect(changes, (moment, 10**9, 0)) if moment else 0
            assert value == (default if not n or changes[n - 1][2] is None else changes[n - 1][2])
    assert len(got) == len(rows) and "collect_list" not in out._jdf.queryExecution().analyzed().toString()


def test_all_nodes_of_a_session_are_linked(spark, monkeypatch):
    """Without a cap a session of forty nodes has all its pairs, in parts that meet each other (before, only those of the fifteen used most)."""
    monkeypatch.setattr(graph, "PART", 8)
    rows = [(1, "d", i, 1) for i in range(40)] + [(2, "d", i, 1) for i in range(5)] + [(3, "d", 7, 1)]
    got = {(r.source_id, r.target_id): (r.n, r.weight) for r in graph.co_access(spark.createDataFrame(rows, "user_id long, day string, node_id long, uses long"), most=None).collect()}
    assert got == {(a, b): (2, 0.32) if b < 5 else (1, 0.3) for a in range(40) for b in range(a + 1, 40)}
