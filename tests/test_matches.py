"""Matches of a batch in blocks against plain Python, and an index that needs no aggregation."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import matches, terms

WORDS = [f"w{i}" for i in range(120)]


def some(n, seed, size=9):
    rng = random.Random(seed)
    return {i * 3: {WORDS[min(119, int(120 * rng.random() ** 3))] for _ in range(size)} for i in range(n)}


def flat(spark, sets, name):
    return spark.createDataFrame([(i, w) for i, s in sets.items() for w in s], f"{name} long, term string")


@pytest.mark.parametrize("k,at_least,share,earlier", [(1, 3, 0.0, False), (5, 1, 0.0, False), (None, 1, 0.5, False), (2, 2, 0.0, True)])
def test_matches_equal_all_pairs(spark, monkeypatch, k, at_least, share, earlier):
    monkeypatch.setattr(matches, "BLOCK", 40)
    monkeypatch.setattr(matches, "TURN", 16)
    queries, store = some(50, 1), some(300, 2)
    got = matches.matches(flat(spark, queries, "query_id"), flat(spark, store, "id"), len(store), k, at_least, share, earlier=earlier)
    want = []
    for q, a in queries.items():
        found = [(-len(a & b), i) for i, b in store.items() if len(a & b) >= max(at_least, share * len(a)) and (not earlier or i < q)]
        want += [(q, i, -n) for n, i in sorted(found)[:k]]
    assert sorted((r.query_id, r.id, r.matched) for r in got.collect()) == sorted(want)


def test_cosines_and_named_pairs(spark, monkeypatch):
    monkeypatch.setattr(matches, "BLOCK", 64)
    queries, store = some(20, 3), some(200, 4)
    q = flat(spark, queries | {999: {"unknown"}}, "query_id").withColumn("weight", F.lit(1.0))
    index = terms.term_frequency(flat(spark, store, "id").withColumn("c", F.length("term")))
    weighed = terms.weighed(q, index, len(store))
    idf, tf = {r.term: r.idf for r in weighed.collect()}, {(r.id, r.term): r.tf for r in index.collect()}

    def cosine(a, i):
        both = [w for w in a if (i, w) in tf]
        dot, square = sum(idf[w] ** 2 * tf[i, w] for w in both), sum((idf[w] * tf[i, w]) ** 2 for w in both)
        return dot / (sum(idf[w] ** 2 for w in a if idf.get(w)) * square) ** 0.5 if both else None

    every = {(a, i): cosine(queries[a], i) for a in queries for i in store}
    best = [(a, i) for a in queries for _, i in sorted((-round(s, 9), i) for (b, i), s in every.items() if b == a and s)[:4]]
    got = {(r.query_id, r.id): r.score for r in matches.matches(weighed, index, len(store), 4).collect()}
    assert sorted(got) == sorted(best) and all(abs(s - every[p]) < 1e-12 for p, s in got.items())
    pairs = [p for p in every if (p[0] + p[1]) % 7 == 0] + [(0, 10**9), (999, 3)]
    got = {(r.query_id, r.id): r.score for r in matches.matches(weighed, index, len(store), pairs=spark.createDataFrame(pairs, "query_id long, id long")).collect()}
    assert sorted(got) == sorted(p for p in pairs if every.get(p)) and all(abs(s - every[p]) < 1e-12 for p, s in got.items())


def test_a_block_lets_out_no_more_than_was_asked_for():
    """A word in all queries and all nodes makes no row for each pair (a join on terms gave 500 * 400)."""
    null = lambda n, kind: pa.nulls(n, kind)
    left = pa.table({"query_id": pa.array(range(500)), "term": ["the"] * 500, "w": null(500, pa.float64()), "idf": null(500, pa.float64()), "id": null(500, pa.int64())})
    out = matches._comparison(False, 2, 1, 0.0, False)(left, pa.table({"id": pa.array(range(400)), "term": ["the"] * 400}))
    assert out.num_rows == 1000 and set(out.column("id").to_pylist()) == {0, 1}


def test_index_holds_one_text_at_a_time(spark):
    nodes = spark.createDataFrame([(1, "Alpha beta alpha, ALPHA gammaDelta the of"), (2, ""), (3, None), (4, "the of")], "id long, content string")
    index = terms.indexed(nodes, F.col("content"))
    assert sorted((r.id, r.term, r.c, round(r.tf, 4)) for r in index.collect()) == [(1, "alpha", 3, 1.0), (1, "beta", 1, 0.6667), (1, "delta", 1, 0.6667), (1, "gamma", 1, 0.6667)]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "Sort [" not in plan


@pytest.mark.parametrize("earlier", [False, True])
def test_nearest_word_sets(spark, earlier):
    from tessera.operators import resolve

    a, b = some(80, 5), some(200, 6)
    b[1000] = a[1000] = set(b[0])
    rows = lambda sets, key: spark.createDataFrame([(i, sorted(s, reverse=i % 2)) for i, s in sets.items()], f"{key} long, words array<string>")
    want = []
    for i, x in a.items():
        found = sorted((-len(x & y), j) for j, y in b.items() if len(x & y) >= 3 and (not earlier or j < i))
        want += [(i, found[0][1], -found[0][0])] if found else []
    assert sorted(map(tuple, resolve.nearest(rows(a, "a"), rows(b, "b"), 3, earlier).collect())) == sorted(want)


def test_a_task_folds_many_sessions(spark):
    """Segments as one fold after another gives them; sessions of a bucket reach Python together (before: one call for each session)."""
    import numpy as np

    from tessera.operators import vectors

    rng = np.random.default_rng(1)
    rows = [(f"s{s}", p, [float(x) for x in rng.normal(1, 1, 8)]) for s in range(60) for p in range(1 + s % 7)] + [("s0", 9, [0.0] * 8), ("s0", 11, [1.0] * 8)]
    want = []
    for name in {r[0] for r in rows}:
        number, recent = 0, []
        for _, p, x in sorted(r for r in rows if r[0] == name):
            m = np.mean(recent, axis=0) if recent else None
            if recent and np.dot(x, m) / max(1e-12, np.linalg.norm(x) * np.linalg.norm(m)) < 0.5:
                number, recent = number + 1, []
            recent = [*recent[-1:], x]
            want.append((name, p, number))
    got = vectors.segments(spark.createDataFrame(rows, "session string, position long, embedding array<double>"), 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "_bucket" in got._jdf.queryExecution().analyzed().toString()


def test_hops_are_dealt_by_their_rows(spark, monkeypatch):
    """A hop of more rows takes more tasks (before: as many as the setting for shuffles says, at any size)."""
    from tessera.operators import graph

    monkeypatch.setattr(graph, "SHARE", 50)
    edges = spark.createDataFrame([(a, b, 0.9) for a in range(30) for b in range(30) if a != b], "source_id long, target_id long, weight double")
    got = graph.spread(spark.createDataFrame([(q, q) for q in range(30)], "query_id long, id long"), edges, 2)
    assert "hashpartitioning(query_id" in got._jdf.queryExecution().executedPlan().toString().replace("#", " ").replace("query_id ", "query_id") and got.rdd.getNumPartitions() > 100
    once, twice = 0.9 * 0.5, 0.9 * 0.25
    found = {(r.query_id, r.id): r.activation for r in got.collect()}
    assert len(found) == 900 and abs(found[0, 0] - (1 + 29 * once * twice)) < 1e-9 and abs(found[0, 1] - (once + twice + 28 * once * twice)) < 1e-9


@pytest.mark.parametrize("k,share,weights", [(3, 0.0, True), (1, 0.0, False), (None, 0.6, False)])
def test_nodes_that_cannot_reach_the_best_are_not_looked_at(monkeypatch, k, share, weights):
    """Queries with a few rare terms among common ones: the same best as of all pairs, while few of a block's nodes are added up (before, all of them for every query)."""
    import numpy as np

    rng = np.random.default_rng(5)
    common, rare, n = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(4000)], 2000
    sets = {i: {*rng.choice(common, 4), *rng.choice(rare, 12)} for i in range(n)}
    asked = {i: {*rng.choice(common, 2), *rng.choice(sorted(sets[i * 7] - set(common)), 5)} for i in range(200)}
    df = {t: sum(t in s for s in sets.values()) for t in {*common, *rare}}
    idf = {t: float(np.log((n + 1) / (df[t] + 1)) + 1) for t in df}
    tf = {(i, t): 0.5 + 0.5 * ((i + len(t)) % 5) / 5 for i, s in sets.items() for t in s}
    flat = [(q, t) for q, s in asked.items() for t in s]
    x = [idf[t] if weights else None for _, t in flat]
    left = pa.table({"query_id": [q for q, _ in flat], "term": [t for _, t in flat], "w": pa.array(x, pa.float64()), "idf": pa.array(x, pa.float64()), "id": pa.nulls(len(flat), pa.int64())})
    right = pa.table({"id": list(sets), "terms": [sorted(s) for s in sets.values()], "tfs": [[tf[i, t] for t in sorted(s)] for i, s in sets.items()]})
    monkeypatch.setattr(matches, "STEP", None)  # adding up a whole block would fail
    got = sorted((r["query_id"], r["id"], r["matched"]) for r in matches._comparison(weights, k, 1, share, False)(left, right).to_pylist())
    want = []
    for q, s in asked.items():
        found = []
        for i, b in sets.items():
            both = s & b
            if both and len(both) >= share * len(s) - 1e-9:
                d = sum((idf[t] * tf[i, t]) ** 2 for t in both)
                found.append((-round(sum(idf[t] ** 2 * tf[i, t] for t in both) / (d * sum(idf[t] ** 2 for t in s)) ** 0.5, 9) if weights else -len(both), i, len(both)))
        want += [(q, i, m) for _, i, m in sorted(found)[:k]]
    assert got == sorted(want)


def test_entries_meet_only_the_first_holders_of_a_word(spark, monkeypatch):
    """Edges of a vocabulary as plain Python gives them, while a word of all titles gives each entry a few rows (before, a row for each entry and title)."""
    from tessera.operators import vocabulary

    met, kept = [], vocabulary.written
    monkeypatch.setattr(vocabulary, "written", lambda df, what: met.append(df.count()) or kept(df, what))
    titles = {i: f"common {WORDS[20 + i % 7]} {WORDS[20 + i % 11]}" for i in range(200)}
    entries = [(i, WORDS[20 + i % 7], ["common", WORDS[20 + (i + 3) % 11]]) for i in range(0, 200, 5)]
    got = vocabulary.connections(spark.createDataFrame(entries, "node_id long, term string, maps_to array<string>"), spark.createDataFrame(list(titles.items()), "id long, title string"))
    want = set()
    for node, term, to in entries:
        first = lambda w, n: [i for i, t in titles.items() if w in t.split() and i != node][:n]  # noqa: E731, B023
        maps = {i for w in set(to) for i in first(w, 5)}
        want |= {(node, i, "maps_to", 0.8) for i in maps} | {(node, i, "refers_to", 0.6) for i in first(term, 3) if i not in maps}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(met) <= 12 * 6


def test_a_task_lets_out_no_more_than_its_memory_holds(spark, monkeypatch):
    """Where a share of all pairs is asked for, blocks are cut by what leaves them (before, by the stored sets alone, whatever the batch); sets may come in lists."""
    monkeypatch.setattr(matches, "PAIRS", 2000)
    queries, store = some(60, 7), some(300, 8)
    lists = spark.createDataFrame([(i, sorted(s)) for i, s in store.items()], "id long, terms array<string>")
    got = matches.matches(flat(spark, queries, "query_id"), lists, len(store), share=0.5)
    assert sorted((r.query_id, r.id, r.matched) for r in got.collect()) == sorted((q, i, len(a & b)) for q, a in queries.items() for i, b in store.items() if 2 * len(a & b) >= len(a))
    assert "sequence(0, 8" in got._jdf.queryExecution().analyzed().toString() and 60 * 300 / 9 <= 2000
