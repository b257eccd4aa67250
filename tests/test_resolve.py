"""Decisions made in rounds against sequential folds, the pruned similarity join against all pairs, and code that reaches Python workers."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resolve, vectors

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def fold(n, links):
    """dropped: kept of nodes 0 to n - 1 in order."""
    near, kept = {}, {}
    for a, b in links:
        near.setdefault(b, set()).add(a)
    for i in range(n):
        alive = [j for j in near.get(i, ()) if j not in kept]
        if alive:
            kept[i] = min(alive)
    return kept


@pytest.mark.parametrize("rest", [0, 40, 10_000])
def test_survivors_equal_a_fold(spark, rest):
    rng = random.Random(rest)
    links = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(500)} | {(i, i + 1) for i in range(60, 80)} | {(5, i) for i in range(200, 260)}
    rows = spark.createDataFrame([(a, b, a, b) for a, b in links], "earlier long, later long, earlier_rank long, later_rank long").repartition(5)
    assert {r.dropped: r.kept for r in resolve.survivors(rows, rest).collect()} == fold(300, links)


def test_survivors_of_no_links(spark):
    assert resolve.survivors(spark.createDataFrame([], "earlier long, later long, earlier_rank long, later_rank long")).collect() == []


def clustered(n, centres, spread, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 16))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, 16)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)


def test_merges_take_every_node_to_a_survivor(spark):
    """Against the fold, with copies of vectors, which all go the way of the first; no merged node is left in nodes or edges."""
    x = clustered(150, 12, 0.12)
    x[100:130] = x[rng_ids := np.arange(30) % 7]
    order = np.random.default_rng(3).permutation(150)
    nodes = frame(spark, x).join(spark.createDataFrame([(int(i), int(k)) for k, i in enumerate(order)], "id long, turn int"), "id")
    ids = resolve.merged(nodes, 0.9, F.col("turn"))
    got = {r.dropped: r.kept for r in ids.collect()}
    sim = x @ x.T
    want = fold(150, [(a, b) for b in range(150) for a in range(b) if sim[order[a], order[b]] > 0.9])
    assert got == {int(order[b]): int(order[a]) for b, a in want.items()} and len(got) > 60 and len(rng_ids)
    rng = random.Random(2)
    edges = [(a, b, round(rng.random(), 3)) for a, b in {tuple(rng.sample(range(150), 2)) for _ in range(600)}]
    after = resolve.merged_edges(spark.createDataFrame(edges, "source_id long, target_id long, weight double"), ids).collect()
    best = {}
    for a, b, w in edges:
        p, q = got.get(a, a), got.get(b, b)
        if p != q:
            best[p, q] = max(best.get((p, q), (False, 0.0)), ((a, b) == (p, q), w))
    assert {(r.source_id, r.target_id): (not r.moved, r.weight) for r in after} == best
    assert not any(r.source_id in got or r.target_id in got for r in after)
    left = resolve.merged_nodes(nodes.withColumn("mark", F.when(F.col("id") % 3 == 0, F.col("id"))), ids, ["turn"], ["turn"][:0], {"mark": F.col("turn")}).collect()
    assert {r.id for r in left} == set(range(150)) - set(got) and sum(r.members for r in left) == 150
    turn = {int(i): k for k, i in enumerate(order)}
    for r in left:
        members = sorted([i for i in range(150) if got.get(i, i) == r.id], key=lambda i: (i != r.id, turn[i]))
        assert r.mark == next((i for i in members if i % 3 == 0), None) and r.turn == sum(turn[i] for i in members)


def plain_absorb(store, items, at_least=3):
    known, out = {}, {}
    for i, title in store:
        place = known[title][1] if title in known else len(known)
        known[title] = (i, place, set(title.lower().split()))
    for i, title, locked, _ in sorted(items, key=lambda r: (not r[2], -r[3], r[0])):
        if title in known:
            out[i] = ("exact", known[title][0], None)
            continue
        best = max(((len(set(title.lower().split()) & w), -place, to) for to, place, w in known.values()), default=(0, 0, 0))
        if best[0] >= at_least:
            out[i] = ("fuzzy", best[2], best[0])
        elif locked:
            out[i] = ("absorbed", None, None)
            known[title] = (i, len(known), set(title.lower().split()))
        else:
            out[i] = ("policy", None, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_absorption_equals_one_title_after_another(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(40)]
    title = lambda: " ".join(rng.choices(words, weights=[8, 6, 4] + [1] * 40, k=rng.randint(1, 7)))
    store = [(i, title()) for i in range(40)] + [(40, "The  of\tAND x"), (41, "w1 w2 w3"), (42, "w1 w2 w3")]
    items = [(100 + i, title(), rng.random() < 0.6, rng.randint(0, 3)) for i in range(120)] + [(300, "w1 w2 w3", True, 1), (301, "", True, 1), (302, "x the OF and", False, 0), (303, "alone", True, 0), (304, "alone", True, 0), (305, "alone", False, 9)]
    got = resolve.absorbed(spark.createDataFrame([*store, (99, None)], "id long, title string"), spark.createDataFrame([*items, (999, None, True, 1)], "id long, title string, locked boolean, uses int").repartition(4), ~F.col("locked"), -F.col("uses"))
    want = plain_absorb(store, items)
    assert {r.id: (r["class"], r.matched, r.overlap) for r in got.collect()} == want
    assert {x[0] for x in want.values()} == {"exact", "fuzzy", "absorbed", "policy"} or seed
    edges = [(a, b, 0.5) for a, b in {tuple(rng.sample(sorted(want), 2)) for _ in range(80)}]
    place = {i: i if k == "absorbed" else to for i, (k, to, _) in want.items() if k != "policy"}
    moved = {(place[a], place[b]) for a, b, _ in edges if a in place and b in place and place[a] != place[b]}
    some = sorted(moved)[:3]
    shape = "source_id long, target_id long, weight double"
    left = resolve.absorbed_edges(spark.createDataFrame(edges, shape), got, spark.createDataFrame([(*x, 1.0) for x in some], shape)).collect()
    assert {(r.source_id, r.target_id) for r in left} == moved - set(some)


@pytest.mark.parametrize("spread,threshold", [(0.02, 0.95), (0.3, 0.6), (3.0, 0.2)])
def test_similarity_join_equals_all_pairs(spark, monkeypatch, spread, threshold):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = clustered(400, 9, spread)
    x[50:60] = x[3]
    x[60:90] *= np.linspace(0.2, 3, 30)[:, None]  # not all of one norm
    got = {(r.a_id, r.b_id): r.similarity for r in vectors.similar_pairs(frame(spark, x), threshold).collect()}
    sim = x @ x.T
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if sim[a, b] > threshold}
    assert set(got) == want and all(abs(got[p] - sim[p]) < 1e-9 for p in want)


def test_similarity_join_compares_few_of_clustered_vectors(spark, monkeypatch):
    """Work in pairs of vectors that meet, against all pairs."""
    monkeypatch.setattr(vectors, "CELL", 50)
    x = clustered(3000, 60, 0.03)
    rows = frame(spark, x).withColumn("_group", F.lit(""))
    left, right = vectors.meetings(rows.select("_group", "id", "embedding"), 0.9)
    size = lambda df, name: df.groupBy("_task").agg(F.count(F.lit(1)).alias(name))
    work = size(left, "l").join(size(right, "r"), "_task").agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    assert work < 0.15 * 3000 * 3000


def test_python_workers_get_the_code():
    """Queries that run Python, in a session whose workers find the package nowhere else."""
    code = (
        "import os, sys; os.environ.pop('PYTHONPATH', None); sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from tessera.plans import catalog\n"
        "print([catalog.QUERIES[q](s, '/root/testdata/sf0.001').count() > 0 for q in ('q_vector_topk', 'q_near_dup_merge')])\n"
    ) % ROOT
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    assert "[True, True]" in out.stdout, out.stderr[-2000:]
