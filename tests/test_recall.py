"""Recall end to end on a small store, the vocabulary as a store, and phrases of time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import recall, terms, vocabulary

NOW = dt.datetime(2024, 2, 1)
NODES = "id long, type string, title string, content string, locked boolean, archived boolean, critical boolean, emotion double, confidence double, stability double, created_at timestamp_ntz, personal string, evolution string, access_count long, last_accessed timestamp_ntz"


def node(i, content, **more):
    row = {"type": "concept", "locked": False, "archived": False, "critical": False, "emotion": 0.0, "confidence": None, "stability": 1.0, "created_at": NOW - dt.timedelta(hours=40), "personal": None, "evolution": None, "access_count": 1, "last_accessed": NOW - dt.timedelta(hours=100)}
    row |= more
    return (i, row["type"], content[:60], content, *(row[c] for c in "locked archived critical emotion confidence stability created_at personal evolution access_count last_accessed".split()))


def scores(spark, nodes, text="worktree locks", edges=(), entries=()):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    n = spark.createDataFrame(nodes, NODES)
    found = recall.keyword_scores(
        spark.createDataFrame([(1, text)], "query_id long, text string"), n, terms.term_frequency(terms.term_counts(n, F.col("content"))), spark.createDataFrame(both, "source_id long, target_id long, weight double"),
        spark.createDataFrame(list(entries), "node_id long, term string, maps_to array<string>"), F.lit(NOW).cast("timestamp_ntz"),
    )
    return {r.id: r.score for r in found.collect()}


def test_neighbours_of_matches_are_recalled(spark):
    """A node without any term of the query comes by its edge, two edges away with less, and not at all when nothing leads there."""
    nodes = [node(1, "worktree locks explained"), node(2, "alpha beta gamma"), node(3, "delta epsilon zeta"), node(4, "eta theta iota"), node(5, "worktree archived", archived=True)]
    got = scores(spark, nodes, edges=[(1, 2, 0.9), (2, 3, 0.9)])
    assert set(got) == {1, 2, 3} and got[1] > got[2] > got[3]


def test_what_slows_forgetting(spark):
    """Fixed marks forget nothing, fluid ones a tenth as fast, nodes beside an open tension a third as fast."""
    old = {"last_accessed": NOW - dt.timedelta(hours=3000)}
    texts = [f"worktree locks {w}" for w in ("one", "two", "three", "four")]
    nodes = [node(1, texts[0], **old), node(2, texts[1], personal="fixed", **old), node(3, texts[2], personal="fluid", **old), node(4, texts[3], **old), node(9, "kappa", evolution="tension")]
    got = scores(spark, nodes, edges=[(4, 9, 0.06)])
    assert got[2] > got[3] > got[4] > got[1]


def test_types_intents_and_critical_nodes(spark):
    nodes = [node(1, "worktree locks aaa"), node(2, "worktree locks bbb", type="project"), node(3, "worktree locks ccc", critical=True), node(4, "worktree locks ddd", type="mechanism")]
    got = scores(spark, nodes, text="how do worktree locks")
    assert got[3] > got[4] > got[1] > got[2]


def test_phrases_of_time_bound_the_recall(spark):
    nodes = [node(i, f"worktree locks n{i}", created_at=NOW - dt.timedelta(days=d)) for i, d in enumerate((1, 4, 40))]
    assert set(scores(spark, nodes, text="worktree locks recently")) == {0}
    assert set(scores(spark, nodes, text="worktree locks last 5 days")) == {0, 1}
    assert set(scores(spark, nodes)) == {0, 1, 2}


@pytest.mark.parametrize("text,low,high", [
    ("what today", "2024-02-01", "2024-02-01 15:00"), ("and Yesterday?", "2024-01-31", "2024-02-01"), ("this week", "2024-01-29", "2024-02-01 15:00"), ("last week", "2024-01-22", "2024-01-29"),
    ("last month", "2024-01-01", "2024-02-01"), ("the last 3 days", "2024-01-29 15:00", "2024-02-01 15:00"), ("last session", "2024-02-01 09:00", "2024-02-01 15:00"), ("nothing", None, None), (None, None, None), ("last 99999999999 days", None, "2024-02-01 15:00"),
])
def test_phrases(spark, text, low, high):
    now = F.lit(dt.datetime(2024, 2, 1, 15)).cast("timestamp_ntz")
    r = spark.createDataFrame([(text,)], "t string").select(recall.phrase_range(F.col("t"), now).alias("s")).select("s.low", "s.high").first()
    at = lambda x: None if x is None else dt.datetime.fromisoformat(x)
    assert (r.low, r.high) == (at(low), at(high))


ENTRIES = [(10, "hook", ["worktree", "locks"]), (11, "gate", ["alpha"]), (12, "gate", ["beta"]), (13, "recall hook", ["gamma", "delta", "epsilon", "zeta"])]
SHAPE = "node_id long, term string, maps_to array<string>"


def test_vocabulary_resolves_and_expands(spark):
    v = spark.createDataFrame(ENTRIES, SHAPE)
    assert {r.term: (r.meanings, r.node_id) for r in vocabulary.resolved(v).collect()} == {"hook": (1, 10), "gate": (2, None), "recall hook": (1, 13)}
    q = spark.createDataFrame([(1, "the recall hook"), (2, "hook and gate"), (3, "locks hook"), (4, ""), (5, None)], "query_id long, text string")
    assert sorted((r.query_id, r.term) for r in vocabulary.expansions(q, v).collect()) == [(1, "delta"), (1, "epsilon"), (1, "gamma"), (2, "locks"), (2, "worktree"), (3, "worktree")]
    assert sorted((r.query_id, r.term, r.meanings) for r in vocabulary.looked_up(q, v).collect()) == [(1, "recall hook", 1), (2, "gate", 2), (2, "hook", 1), (3, "hook", 1)]


def test_vocabulary_admits_and_finds_gaps(spark):
    v = spark.createDataFrame([*ENTRIES, (14, "the", ["x"]), (15, "common", ["y"])], SHAPE)
    frequencies = spark.createDataFrame([("common", 6), ("hook", 5)], "term string, df long")
    assert {r.term for r in vocabulary.admitted(v, frequencies, 100).collect()} == {"hook", "gate", "recall hook"}
    asked = spark.createDataFrame([(1, "hook widget gizmo"), (2, "widget recall"), (3, "learned")], "query_id long, text string")
    assert {r.term: r.n for r in vocabulary.gaps(asked, v, spark.createDataFrame([("learned",)], "term string")).collect()} == {"widget": 2, "gizmo": 1}


def test_expansion_reaches_nodes_without_the_word(spark):
    nodes = [node(1, "worktree locks explained"), node(2, "alpha beta gamma")]
    assert set(scores(spark, nodes, text="about hook", entries=ENTRIES)) == {1}
    assert scores(spark, nodes, text="about gate", entries=ENTRIES) == {}


def test_contextual_nodes_lose_where_the_context_is_strange(spark):
    q = spark.createDataFrame([(1, "deploy the server")], "query_id long, text string")
    semantic = spark.createDataFrame([(1, i, 0.5) for i in range(5)], "query_id long, id long, score double")
    keyword = spark.createDataFrame([(1, 4, "concept", "general", 1.0)], "query_id long, id long, type string, intent string, score double")
    nodes = spark.createDataFrame([(0, "concept", False, None, "contextual", ["deploy"], False), (1, "concept", False, None, "contextual", ["cooking"], False), (2, "concept", False, None, None, ["x"], False), (3, "concept", True, None, None, [], False), (4, "concept", False, None, None, [], False)],
                                  "id long, type string, critical boolean, confidence double, personal string, context array<string>, archived boolean")
    got = {r.id: (round(r.score, 6), r.mismatch) for r in recall.hybrid(semantic, keyword, q, nodes).collect()}
    assert got == {0: (0.5, False), 1: (0.35, True), 2: (0.5, False), 3: (1.5, False), 4: (0.55, False)}
