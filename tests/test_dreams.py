"""Dreams on small stores: draws without repeats, walks that meet or are joined, thoughts, and proposals over time."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import dreams

NOW = dt.datetime(2024, 2, 1)
NODES = "id long, type string, title string, project string, locked boolean, archived boolean, emotion double, last_accessed timestamp_ntz"
EDGES = "source_id long, target_id long, weight double"


def clock():
    return F.lit(NOW).cast("timestamp_ntz")


def node(i, **more):
    row = {"type": "concept", "title": f"title {i}", "project": "p", "locked": False, "archived": False, "emotion": 0.0, "last_accessed": NOW - dt.timedelta(hours=1)} | more
    return (i, *(row[c] for c in "type title project locked archived emotion last_accessed".split()))


def both(edges):
    return [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]


def test_seeds_are_drawn_once_and_from_those_that_take_part(spark):
    rows = [node(i, archived=i % 10 == 0, locked=i % 4 == 1, type="mechanism" if i % 8 == 1 else "rule") for i in range(400)]
    degrees = spark.createDataFrame([(2, 5)], "id long, degree long")
    got = dreams.seeds(spark.createDataFrame(rows, NODES), degrees, clock(), 4, dreams=10).collect()
    assert len(got) == 4 * 20 and len({r.id for r in got}) == len(got)
    assert all(r.id % 10 and (r.id % 4 != 1 or r.id % 8 == 1) for r in got)
    for night in range(4):
        assert sorted((r.dream, r.side) for r in got if r.night == night) == [(d, s) for d in range(1, 11) for s in (0, 1)]
        assert sum(r.id % 4 == 1 for r in got if r.night == night) <= 5


def test_heavy_nodes_are_drawn_more_often(spark):
    rows = spark.createDataFrame([node(i, emotion=1.0 if i < 10 else 0.0) for i in range(35)], NODES)
    degrees = spark.createDataFrame([(i, 2000) for i in range(10)], "id long, degree long")
    drawn = [r.id for seed in range(8) for r in dreams.seeds(rows, degrees, clock(), 1, dreams=2, seed=seed).collect()]
    assert len(drawn) == 32 and sum(i < 10 for i in drawn) > 24


def test_empty_stores_and_stores_of_one_node(spark):
    none = spark.createDataFrame([], EDGES)
    for rows in ([], [node(1)]):
        assert dreams.dream(spark.createDataFrame(rows, NODES), none, clock(), 1).count() == 0


def test_what_dreams_leave(spark):
    """Two nodes without edges: the walks stay, types and projects differ, one is felt; nulls are no difference."""
    rows = spark.createDataFrame([node(1, type="rule", emotion=0.9, title=None), node(2, project="q")], NODES)
    edges = spark.createDataFrame([], EDGES)
    dreamt = dreams.dream(rows, edges, clock(), 1)
    (d,) = dreamt.collect()
    assert (d.walk_a, d.walk_b) == ([d.seed_a], [d.seed_b]) and not d.joined
    assert (d.interest, d.surfaces, d.thought) == (3 + 1 + 2 + 2 + 0, True, True)
    (left,) = dreams.intuitions(dreamt, rows).collect()
    assert set(left.targets) == {1, 2} and "title 2" in left.title and "?" in left.title and left.content.startswith('Association: "')
    linked = dreams.dream(rows, spark.createDataFrame(both([(1, 2, 0.5)]), EDGES), clock(), 1)
    (d,) = linked.collect()
    assert (d.walk_a, d.walk_b) == ([d.seed_a, d.seed_b], [d.seed_b, d.seed_a]) and d.joined
    assert dreams.intuitions(linked, rows).count() == 0


def test_proposals_mature_expire_and_are_made_once(spark):
    at = [NOW - dt.timedelta(minutes=m) for m in (240, 120, 119)]
    candidates = [
        (0, 1, 1, 2, at[0]), (0, 2, 5, 5, at[0]), (0, 3, 2, 1, at[0]), (0, 4, 3, 4, at[0]), (0, 5, 6, 7, at[0]), (0, 6, 8, 9, at[0]),  # its ends are one, the pair is turned, and one over three
        (1, 1, 2, 1, at[1]), (1, 2, 10, 11, at[1]), (2, 1, 8, 9, at[2]), (2, 2, 12, 13, at[2]),
    ]
    df = spark.createDataFrame(candidates, "night long, dream long, source_id long, target_id long, at timestamp_ntz")
    edges, later = both([(12, 13, 0.3)]), both([(12, 13, 0.3), (3, 4, 0.3), (10, 11, 0.3)])
    got = dreams.proposals(df, spark.createDataFrame(edges, EDGES), spark.createDataFrame(later, EDGES), clock())
    assert {(r.night, r.source_id, r.target_id): r.status for r in got.collect()} == {(0, 1, 2): "created", (0, 3, 4): "expired", (0, 6, 7): "created", (1, 10, 11): "expired", (2, 8, 9): "pending"}
