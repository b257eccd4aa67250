"""Connected components of an undirected graph given as pairs of longs, by alternating large and small stars."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash, unstash


#: Pairs that one task thins to a forest before the first round.
LOCAL = 1 << 18


def _forest(batches):
    """Of the pairs of one task those that connect something."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        kept = []
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node u sends its larger neighbours to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node u sends itself and its smaller neighbours to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a pair that is not itself the root, the least node of its component.

    Tasks first thin their pairs to forests, so that groups of many links do not make long rounds. edges: columns u, v (long); loops, repeated and swapped pairs do no harm. Each round is written to the shared folder,
    so that no lineage grows, and the rounds end when one changes nothing (their number grows with the logarithm of
    the longest path). Stars shuffle by node with sums first, and only the joins see a hub's edges together, which adaptive
    execution splits.
    """
    now = stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if pairs := now.count():
        thinned = stash(now.repartition(math.ceil(pairs / LOCAL)).mapInArrow(_forest, "u long, v long"), "edges")
        unstash(now)
        now = thinned
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if tuple(seen) == mark or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        after = stash(_small_star(_large_star(now)), "edges")
        unstash(now)
        now = after
