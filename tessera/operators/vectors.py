"""Dense-vector operators: cosine of unit vectors, top-k of a query batch, similar pairs, centroids, clusters, segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import ship_code, written

#: Vectors, and query vectors, of one block; two blocks meet as one matrix product.
BLOCK = 4096
#: Vectors for which a join draws a pivot, and the most pivots.
CELL, PIVOTS = 2048, 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision (the cosine of unit vectors)."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """rows with _block, dealt by a hash of key, and the number of blocks."""
    n = max(1, -(-rows.count() // BLOCK))
    return rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """query_id, rank, id, score: the k nearest of each query (query_id, vector) among vectors (id, embedding), ties to the smaller id.

    The stated query set goes against all vectors in blocks: each block of queries meets each block of vectors in one task, which gives every
    query its own k best by a matrix product, and a window over these merges them. Only k rows a query and block are shuffled after that.
    """
    ship_code(vectors.sparkSession)
    asked, turns = _blocks(queries.select("query_id", "vector"), "query_id")
    stored, blocks = _blocks(vectors.select("id", "embedding"), "id")
    asked = asked.withColumnRenamed("_block", "_turn").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    stored = stored.select("id", "embedding", F.col("_block").alias("_block_2"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("_turn_2"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        qid, vid, v = left.column("query_id").to_numpy(), right.column("id").to_numpy(), _matrix(right.column("embedding"))
        found, q = [out.empty_table()], _matrix(left.column("vector"))
        for at in range(0, len(q), 512):
            scores, own = q[at : at + 512] @ v.T, qid[at : at + 512]
            if exclude_self:
                scores[own[:, None] == vid[None, :]] = -np.inf
            n = min(k, len(vid))
            cut = np.partition(scores, len(vid) - n, axis=1)[:, len(vid) - n]
            r, c = np.nonzero((scores >= cut[:, None] - 1e-12) & np.isfinite(scores))
            found.append(pa.Table.from_arrays([pa.array(own[r]), pa.array(vid[c]), pa.array(scores[r, c])], schema=out))
        return pa.concat_tables(found)

    found = asked.groupBy("_turn", "_block").cogroup(stored.groupBy("_turn_2", "_block_2")).applyInArrow(compare, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _cells(rows: DataFrame, threshold: float) -> DataFrame:
    """_group, id, embedding, home, visits: the nearest pivot of each vector, and the smaller numbers of cells that may hold a vector that is like it.

    Vectors over the threshold are within a distance that follows from it and the greatest norm; a vector visits the cells whose border (halfway to their
    pivot) is no farther. Pivots are a seeded sample, as many as CELL asks for and PIVOTS at most.
    """
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(dot(F.col("embedding"), F.col("embedding"))).alias("square")).first()
    k = min(PIVOTS, -(-about.n // CELL))
    drawn = rows.select("embedding").orderBy(F.xxhash64("id"), "id").limit(k).collect() if k > 1 else []
    pivots = np.array([r.embedding for r in drawn], np.float64)
    reach = max(0.0, 2 * (about.square or 0.0) - 2 * threshold) ** 0.5

    def place(batches):
        squares = (pivots * pivots).sum(1)
        gaps = np.sqrt(np.maximum(0, squares[:, None] + squares[None] - 2 * pivots @ pivots.T))
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            d = squares[None] - 2 * x @ pivots.T  # squared distances but for a term of the row's own
            home = d.argmin(1)
            border = (d - d[np.arange(len(x)), home][:, None]) <= 2 * gaps[home] * (reach + 1e-6) + 1e-6
            visits = [np.flatnonzero(b[:h]).tolist() for b, h in zip(border, home)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "home", "visits"])

    if not drawn:
        return rows.withColumn("home", F.lit(0)).withColumn("visits", F.array().cast("array<int>"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", home int, visits array<int>")


def meetings(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The two sides of an exact join of vectors (_group, id, embedding) over a threshold, with the tasks (_task) in which they meet.

    A cell's own vectors meet one another, and those that visit it, in blocks of BLOCK.
    """
    placed = written(_cells(rows, threshold), "cells")
    at = placed.select("_group", F.col("home").alias("cell"), F.lit(1).alias("own")).unionByName(placed.select("_group", F.explode("visits").alias("cell"), F.lit(0).alias("own")))
    sizes = at.groupBy("_group", "cell").agg(F.sum("own").alias("h"), F.count_if(F.col("own") == 0).alias("v"))
    blocks = sizes.select("_group", "cell", F.ceil(F.col("h") / BLOCK).cast("int").alias("s"), F.ceil(F.col("v") / BLOCK).cast("int").alias("w"))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    own = placed.select("_group", F.col("home").alias("cell"), "id", "embedding").join(blocks, ["_group", "cell"]).withColumn("p", part(F.col("s")))
    guests = placed.select("_group", F.explode("visits").alias("cell"), "id", "embedding").join(blocks.filter("s > 0"), ["_group", "cell"]).withColumn("p", F.col("s") + part(F.col("w")))
    task = lambda a, b: F.struct("_group", "cell", a.alias("a"), b.alias("b")).alias("_task")
    left = own.withColumn("q", F.explode(F.sequence(F.col("p"), F.col("s") + F.col("w") - 1))).select(task(F.col("p"), F.col("q")), "id", "embedding")
    right = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("p")))).unionByName(guests.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s") - 1))))
    return left, right.select(task(F.col("q"), F.col("p")), "id", "embedding")


def similar_pairs(vectors: DataFrame, threshold: float, group: str | None = None) -> DataFrame:
    """a_id < b_id, similarity of all pairs of vectors (id, embedding) whose inner product is over the threshold, of one group if asked for.

    Exact: vectors are dealt to the cells of pivots, and each meets only its own cell and those whose border is near enough for a vector over the threshold;
    where vectors are clustered and the threshold is high, these are few. Without structure all blocks meet all. Within a task a
    matrix product finds the pairs, and only those over the threshold leave it.
    """
    ship_code(vectors.sparkSession)
    rows = vectors.select((F.col(group).cast("string") if group else F.lit("")).alias("_group"), "id", "embedding")
    left, right = meetings(rows, threshold)
    right = right.select(F.col("_task").alias("_task_2"), F.col("id").alias("id_2"), F.col("embedding").alias("embedding_2"))  # columns of their own, as both sides come from one table

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        found, x, y, ids, others = [out.empty_table()], _matrix(a.column("embedding")), _matrix(b.column("embedding_2")), a.column("id").to_numpy(), b.column("id_2").to_numpy()
        task = a.column("_task")[0].as_py()
        for at in range(0, len(x), 512):
            products = x[at : at + 512] @ y.T
            keep = products > threshold
            if task["a"] == task["b"]:
                keep &= ids[at : at + 512, None] < others[None, :]
            r, c = np.nonzero(keep)
            p, q = ids[at + r], others[c]
            found.append(pa.Table.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(products[r, c])], schema=out))
        return pa.concat_tables(found)

    return left.groupBy("_task").cogroup(right.groupBy("_task_2")).applyInArrow(compare, "a_id long, b_id long, similarity double")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """group, pos (from 0), mean of the vectors' components, size."""
    parts = vectors.select(group, F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("size"))


#: Rows of a stream that one task folds at a time, about.
STREAM = 65536


def segments(stream: DataFrame, threshold: float = 0.74) -> DataFrame:
    """session, position, segment: a new segment where a vector is less similar than threshold to the mean of the last two of its segment.

    stream: session (string), position (long), embedding. State restarts at each boundary, so a session is folded in order. Sessions are many and short, so a task takes
    a bucket of them, makes the products of neighbours for all at once, and folds over these numbers.
    """
    n = max(1, -(-stream.count() // STREAM))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("session", "ascending"), ("position", "ascending")])
        x, session = t.column("embedding").combine_chunks(), t.column("session").combine_chunks().dictionary_encode().indices.to_numpy()
        v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(session), -1)
        by = lambda k: np.r_[np.zeros(min(k, len(v))), np.einsum("ij,ij->i", v[k:], v[:-k])].tolist()
        square, one, two, out = np.einsum("ij,ij->i", v, v).tolist(), by(1), by(2), []
        number, held, before = 0, 0, -1
        for i, s in enumerate(session.tolist()):
            if s != before:
                number, held, before = 0, 0, s
            if held:  # the mean of the last vector, or of the last two, by its products
                product = one[i] if held == 1 else (one[i] + two[i]) / 2
                size = square[i - 1] if held == 1 else (square[i - 1] + square[i - 2] + 2 * one[i - 1]) / 4
                if product / max(1e-12, (square[i] * max(size, 0.0)) ** 0.5) < threshold:
                    number, held = number + 1, 0
            held = min(2, held + 1)
            out.append(number)
        return pa.table({"session": t.column("session"), "position": t.column("position"), "segment": pa.array(out, pa.int64())})

    dealt = stream.select("session", "position", "embedding", F.pmod(F.xxhash64("session"), F.lit(n)).alias("_bucket"))
    return dealt.groupBy("_bucket").applyInArrow(fold, "session string, position long, segment long")
