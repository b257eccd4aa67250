"""Centroid clustering of integer vectors with exact means, nearest centroids found by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid that it had before (at first: to one of nearest norm) bounds its least distance from
above, so only centroids whose norms differ from its own by no more than this bound can be as near; two binary searches find them. These, those on
the rim of the annulus among them, are compared exactly. All arithmetic that decides is in integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash, unstash

#: Numbers in one block of compared distances.
BLOCK = 1 << 20
#: Below this, sums of products are exact in floating point.
EXACT = 1 << 52


class Annulus:
    """Centroids by norm, and the exact nearest of each row of a matrix."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.squares = (centroids * centroids).sum(1)
        self.order = np.lexsort((np.arange(len(centroids)), self.squares))
        self.norms = np.sqrt(self.squares[self.order].astype(np.float64))
        self.most = int(np.abs(centroids).max(initial=0))

    def span(self, squares: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place in the order of norms that a vector's annulus holds; widened by more than square roots are off."""
        norm, radius = np.sqrt(squares.astype(np.float64)), np.sqrt(bound.astype(np.float64))
        slack = 1e-6 + 1e-12 * (norm + radius)
        return np.searchsorted(self.norms, norm - radius - slack, "left"), np.searchsorted(self.norms, norm + radius + slack, "right")

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smallest) and its squared distance. before: a centroid of each row, or -1."""
        squares = (x * x).sum(1)
        near = self.order[np.minimum(np.searchsorted(self.norms, np.sqrt(squares.astype(np.float64))), len(self.order) - 1)]
        start = np.where(before >= 0, before, near)
        low, high = self.span(squares, ((x - self.centroids[start]) ** 2).sum(1))
        floating = int(np.abs(x).max(initial=0)) * self.most * x.shape[1] < EXACT
        found, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
        rows = np.lexsort((high, low))  # neighbours in this order have almost the same annulus, and are compared together
        at = 0
        while at < len(rows):
            some = rows[at : at + max(1, BLOCK // int((high - low)[rows[at]]))]
            columns = np.sort(self.order[low[some].min() : high[some].max()])
            c = self.centroids[columns]
            products = (x[some].astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if floating else x[some] @ c.T
            d = squares[some, None] - 2 * products + self.squares[columns]
            best = d.argmin(1)
            found[some], distance[some] = columns[best], d[np.arange(len(some)), best]
            at += len(some)
        return found, distance


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, v (array<long>): floor(scale * x) of the vectors that have just dims components, none null or not finite.

    Integers so large that a squared distance could overflow a long are an error.
    """
    most = math.isqrt((1 << 61) // dims) // 2
    e = F.col(f"`{vector_col}`")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= most, y).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))

    return vectors.filter((F.size(e) == dims) & good).select(F.col(f"`{id_col}`"), F.transform(e, whole).alias("v"))


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k clusters of vectors after so many rounds of exact integer means, and one assignment more.

    Centroids start as the k vectors with smallest SHA-256 of `1:<id>`, ties by the vector. Returns id_col, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256 for every kept row. Vectors null, of another length, or with a null or non-finite component are left out; fewer kept ones than k
    start as many clusters; a null id counts as the empty text, repeated rows each count; an empty table gives an empty result; other columns are ignored.
    Each round reads the vectors and what they were assigned to from a table in the shared folder. Sums are made by Spark, one row of sums a cluster; the
    driver and each task hold k * dims integers.
    """
    rows = quantised(vectors, dims, scale, id_col, vector_col)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = rows.select(key.alias("_key"), "v").orderBy("_key", "v").limit(k).collect()
    if not seeds:
        return rows.select(F.col(f"`{id_col}`"), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = np.array([s.v for s in seeds], np.int64)
    names = [id_col, "v", "cluster", "distance"]
    shape = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, v array<long>, cluster int, distance long"

    def assign(now: DataFrame, centroids: np.ndarray) -> DataFrame:
        def search(batches):
            annulus = Annulus(centroids)
            for batch in batches:
                x = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, dims)
                found, distance = annulus.nearest(x, np.asarray(batch.column(2).fill_null(-1), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(distance)], names)

        return stash(now.select(F.col(f"`{id_col}`"), "v", "cluster").mapInArrow(search, shape), "annulus")

    now = assign(rows.withColumn("cluster", F.lit(None).cast("int")), centroids)
    for _ in range(rounds):
        sums = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(dims)]).alias("sums")).collect()
        centroids = centroids.copy()
        for s in sums:
            centroids[s.cluster] = [x // s.n for x in s.sums]
        before, now = now, assign(now, centroids)
        unstash(before)
    totals = now.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # one row a cluster
    inertia = sum(t.d for t in totals)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = now.sparkSession.createDataFrame([(t.cluster, t.d, inertia, digests[t.cluster]) for t in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select(F.col(f"`{id_col}`"), "cluster", "distance").join(F.broadcast(own), "cluster").select(F.col(f"`{id_col}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
