"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors fall into bands by the power of two next to their norm, each with lists of its own, so that no long vector distorts the
lists of others. In a band inner products become distances by one more coordinate, sqrt(M * M - |v| * |v|) with M its largest norm
(0 for queries), all divided by M and queries by their norm: the nearest point then has the largest product. Centroids come
from a balanced k-means over a bounded sample, their number is twice the square root of the band's size, and
every vector is entered in the list of its nearest centroid, boundary vectors in several that lie on different sides. Centroids are
searched through an in-memory neighbour graph. A query reads the nearest lists whose centroids are within a ratio of the nearest
distance; ratio and number are the least with which queries from the sample find TARGET of their neighbours in it, so that
clustered vectors are read sparingly and vectors without structure as widely as they need. The vectors of a list are held against its queries
as one matrix product in double precision.

Equal vectors are one class, which keeps its k + 1 smallest ids (no query needs more), so that no group of copies, however
large, makes long lists or repeated searches. Long lists and lists with many queries are dealt to blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash

#: Vectors that the centroids are fitted on, the first by a hash; of these for each centroid at least; queries among them that fix the ratio.
SAMPLE, EACH, TRIALS = 20_000, 8, 512
ROUNDS, PENALTY, NEIGHBOURS, LINKS = 10, 0.02, 16, 4
#: Lists that a vector is entered in, and how much farther than the nearest they may be.
COPIES, COPY_RATIO = 4, 1.15
#: Share of the neighbours of sampled queries that the lists read must hold; lists that a search looks for at first.
TARGET, WIDTH = 0.92, 32
#: Classes, and queries, that meet in one block.
BLOCK = 4096


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(points: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """So many centroids with about equally many points each: k-means where full clusters look farther away."""
    rng = np.random.default_rng(seed)
    centres, weight = points[rng.choice(len(points), count, replace=False)].copy(), np.ones(count)
    for _ in range(ROUNDS):
        near = np.empty(len(points), np.int64)
        for i in range(0, len(points), 4096):
            d = _apart(points[i : i + 4096], centres)
            near[i : i + 4096] = (d + PENALTY * d.mean() * np.log(weight)[None, :]).argmin(1)
        sizes = np.bincount(near, minlength=count)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(sizes)
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        centres[full] = np.add.reduceat(points[order], starts, axis=0) / sizes[full, None]
        weight = np.maximum(sizes, 0.3) * count / len(points)
    return centres


class CentroidGraph:
    """Centroids linked to their nearest and to some far ones, searched from a few entries by a beam."""

    def __init__(self, centroids: np.ndarray, seed: int = 0):
        rng, n = np.random.default_rng(seed), len(centroids)
        self.centroids = centroids.astype(np.float32)
        self.links = np.empty((n, min(NEIGHBOURS, n) + LINKS), np.int32)
        for i in range(0, n, 1024):
            near = _apart(self.centroids[i : i + 1024], self.centroids).argsort(1)[:, : min(NEIGHBOURS, n)]
            self.links[i : i + 1024] = np.concatenate([near, rng.integers(0, n, (len(near), LINKS))], 1)
        self.entries = rng.choice(n, min(n, 4 * math.isqrt(n) + 8), replace=False)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the nearest centroids found and their distances, nearest first; up to width."""
        n, width = len(self.centroids), min(width, len(self.centroids))
        x = x.astype(np.float32)
        d = np.full((len(x), n), np.inf, np.float32)  # what has been measured
        done = np.zeros((len(x), n), bool)
        d[:, self.entries] = _apart(x, self.centroids[self.entries])
        rows = np.arange(len(x))[:, None]
        while True:
            beam = np.argpartition(d, width - 1, axis=1)[:, :width]
            fresh = ~done[rows, beam] & np.isfinite(d[rows, beam])
            if not fresh.any():
                break
            score = np.where(fresh, d[rows, beam], np.inf)
            some = min(8, width)
            pick = np.argpartition(score, some - 1, axis=1)[:, :some]
            r, p = np.nonzero(np.isfinite(np.take_along_axis(score, pick, 1)))
            nodes = beam[r, pick[r, p]]
            done[r, nodes] = True
            rr, cc = np.repeat(r, self.links.shape[1]), self.links[nodes].ravel()
            new = ~np.isfinite(d[rr, cc])
            rr, cc = rr[new], cc[new]
            diff = x[rr] - self.centroids[cc]
            d[rr, cc] = np.einsum("ij,ij->i", diff, diff)
        order = np.take_along_axis(beam, np.argsort(d[rows, beam], 1), 1)
        return order, np.sqrt(d[rows, order])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows in double precision; shorter ones end in zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy() - column.offsets[0].as_py()
    if (np.diff(offsets) == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of norms up to this one as points on the unit sphere."""
    x = x / norm
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], 1)


def _directions(x: np.ndarray) -> np.ndarray:
    """Queries as points on the unit sphere."""
    x = x / np.abs(x).max(1, keepdims=True)
    return np.concatenate([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)


class Band(NamedTuple):
    """Largest norm, number of the first list, the centroids, and how many lists a query reads and how much farther than the nearest they may be."""

    norm: float
    first: int
    graph: CentroidGraph
    ratio: float
    probes: int

    def entered(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and others almost as near, unless a chosen one is nearer to them than the vector is."""
        found, d = self.graph.search(_lifted(x, self.norm), 4 * COPIES)
        out = []
        for row, dist in zip(found, d):
            chosen = [0]
            for j in range(1, int((dist <= COPY_RATIO * dist[0]).sum())):
                if len(chosen) < COPIES and all(((self.graph.centroids[row[j]] - self.graph.centroids[row[i]]) ** 2).sum() > dist[j] ** 2 for i in chosen):
                    chosen.append(j)
            out.append([self.first + int(row[j]) for j in chosen])
        return out

    def read(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
        """Lists that each query (a direction) reads: those within the ratio, and further ones until they hold so many entries."""
        n, width, out, todo = len(self.graph.centroids), WIDTH, [[] for _ in x], np.arange(len(x))
        while len(todo):
            found, d = self.graph.search(x[todo], width)
            held = np.cumsum(sizes[self.first + found], axis=1)
            place = np.arange(found.shape[1])[None, :]
            within = (d <= self.ratio * d[:, :1]) & (place < self.probes) | (place <= (held < least).sum(1)[:, None])
            done = ~within[:, -1] | (width >= n)
            for q, row, take in zip(todo[done], found[done], within[done]):
                out[q] = (self.first + row[take]).tolist()
            todo, width = todo[~done], 2 * width
        return out


def fitted(band: Band, x: np.ndarray, k: float) -> Band:
    """The band with the least ratio, and number of lists, with which the first vectors of a sample find TARGET of their k nearest in it, one at least."""
    trials, k = x[:TRIALS], min(max(1, math.ceil(k)), len(x) - 1)
    lifted, asked = _lifted(x, band.norm), _directions(trials)
    lists = [of for i in range(0, len(x), 512) for of in band.entered(x[i : i + 512])]  # in parts, as a search measures many centroids at once
    products = asked @ lifted.T
    products[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    d = np.sqrt(_apart(asked.astype(np.float32), band.graph.centroids))
    place, ratio = d.argsort(1).argsort(1), d / np.maximum(d.min(1, keepdims=True), 1e-6)
    best = [(q, min((place[q, i - band.first], ratio[q, i - band.first]) for i in lists[v])) for q in range(len(trials)) for v in np.argpartition(-products[q], k - 1)[:k]]
    share = (1 + TARGET) / 2  # each of the two may lose half of what may be lost
    return band._replace(ratio=float(np.quantile([r for _, (_, r) in best], share)) * (1 + 1e-6), probes=int(np.quantile([p for _, (p, _) in best], share)) + 1)


def fit_bands(sample: dict[int, np.ndarray], about: dict[int, tuple[int, float]], dim: int, k: int) -> dict[int, Band]:
    """about: number of classes and largest norm of every band. A band of which too little is in the sample has one list.

    Of the k nearest of all vectors a sample holds as many as its share of them, and these are its nearest.
    """
    out, first = {}, 0
    for band, (n, norm) in sorted(about.items()):
        x = sample.get(band, np.zeros((0, dim)))
        count = max(1, min(math.ceil(2 * math.sqrt(n)), len(x) // EACH))
        centres = balanced_centroids(_lifted(x, norm), count) if count > 1 else np.ones((1, dim + 1))
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)  # on the sphere, as the points are
        made = Band(norm, first, CentroidGraph(centres), 1.0, 1)
        out[band] = fitted(made, x, k * len(x) / n) if count > 1 else made
        first += count
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (array<double>), key (of equal vectors) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(fit).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    return rows.withColumn("key", F.concat(F.hex(F.xxhash64("vec")), F.hex(F.hash("vec"))))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest others of each row for which is_query (a function of the id column) holds.

    Returns query_id, rank (from 1), vec_id, score (inner product, double), ties to the smaller id; fewer than k where
    fewer others exist. Rows with null id, and vectors null, empty, zero or with null or non-finite components, take no
    part; shorter vectors count as ending in zeros; repeated rows count once; an empty table gives an empty result; other columns are ignored.
    The number of lists is bounded by the sample (SAMPLE / EACH): far beyond its square, lists grow longer and are dealt to blocks.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    first = Window.partitionBy("key").orderBy("id")
    firsts = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    most = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    norm = most * F.sqrt(F.aggregate(F.transform("vec", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))
    classes = firsts.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")).withColumn("norm", norm)
    classes = stash(classes.withColumn("band", F.floor(F.log2("norm") + 0.5).cast("int")), "classes")
    # One row for each power of two among the norms, of which doubles have about two thousand.
    found = classes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max(F.size("vec")).alias("dim")).collect()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(r.dim for r in found)
    drawn = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("band", "vec").toArrow()
    of_band, sample = drawn.column("band").to_numpy(), _matrix(drawn.column("vec").combine_chunks(), dim)
    bands = fit_bands({r.band: sample[of_band == r.band] for r in found}, {r.band: (r.n, r.norm) for r in found}, dim, k)
    shared = spark.sparkContext.broadcast(bands)

    def lists_of(choose):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    chosen = choose(shared.value, _matrix(part.column("vec"), dim), part.column("band").to_numpy())
                    kept = [n for n in part.schema.names if n != "band"]
                    yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(chosen, pa.list_(pa.int32()))], [*kept, "lists"])

        return run

    def enter(known, x, of_band):
        out = [[] for _ in x]
        for band in np.unique(of_band).tolist():
            at = np.flatnonzero(of_band == band)
            for i, lists in zip(at.tolist(), known[band].entered(x[at])):
                out[i] = lists
        return out

    entered = stash(classes.select("key", "ids", "vec", "band").mapInArrow(lists_of(enter), "key string, ids array<long>, vec array<double>, lists array<int>"), "entered")
    asking = rows.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "key").distinct()
    asked = classes.join(asking.select("key").distinct(), "key", "left_semi").select("key", "vec", "band")
    lengths = np.zeros(sum(len(b.graph.centroids) for b in bands.values()), np.int64)
    for r in entered.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # one row per list
        lengths[r["list"]] = r["count"]

    def read(known, x, _):
        lists = [band.read(_directions(x), lengths, COPIES * (k + 1)) for band in known.values()]
        return [[i for of in each for i in of] for each in zip(*lists)]

    asked = stash(asked.mapInArrow(lists_of(read), "key string, vec array<double>, lists array<int>"), "asked")
    entries, reads = entered.withColumn("list", F.explode("lists")), asked.withColumn("list", F.explode("lists"))
    # One row per list, so bounded by the sample.
    sizes = entries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(reads.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns")), "list")
    sizes = F.broadcast(stash(sizes, "lists"))
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = entries.join(sizes, "list").withColumn("block", deal("blocks")).select("list", "block", every("turns").alias("turn"), "key", "ids", "vec")
    reads = reads.join(sizes, "list").withColumn("turn", deal("turns")).select("list", every("blocks").alias("block"), "turn", "key", "vec")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left.column("ids").combine_chunks(), right.column("key").to_pylist()
        out = {"asked": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            least = np.array([x[0] for x in ids.to_pylist()])
            v, q = _matrix(left.column("vec").combine_chunks(), dim), _matrix(right.column("vec").combine_chunks(), dim)
            top = min(k + 1, len(v))
            for at in range(0, len(q), 256):
                products = q[at : at + 256] @ v.T
                cuts = np.partition(products, len(v) - top, axis=1)[:, len(v) - top]
                for i, row in enumerate(products):
                    close = np.flatnonzero(row >= cuts[i] - 1e-9 * max(1.0, abs(cuts[i])))
                    exact = (v[close] * q[at + i]).sum(1)
                    best = np.lexsort((least[close], -exact))[:top]
                    out["asked"] += [keys[at + i]] * len(best)
                    out["ids"].append(close[best])
                    out["score"].append(exact[best])
        picked = np.concatenate(out["ids"]) if out["ids"] else np.zeros(0, int)
        scores = np.concatenate(out["score"]) if out["score"] else np.zeros(0)
        return pa.table({"asked": pa.array(out["asked"], pa.string()), "ids": ids.take(pa.array(picked)), "score": pa.array(scores)})

    on = ("list", "block", "turn")
    met = entries.groupBy(*on).cogroup(reads.groupBy(*on)).applyInArrow(compare, "asked string, ids array<long>, score double")
    # Replicas of a class give equal rows.
    best = met.groupBy("asked", F.col("ids")[0].alias("least")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    ranked = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    best = best.select("asked", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = asking.join(best, F.col("key") == F.col("asked")).filter(F.col("id") != F.col("query_id"))
    return out.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
