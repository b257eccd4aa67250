"""Graph operators over edges (source_id, target_id, weight), stored in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.sources.shared import written

#: Rows of a hop that one task adds up, about; nodes of a session that meet one another in one task.
SHARE, PART = 1_000_000, 512


def co_access(sessions: DataFrame, keys=("user_id", "day"), most: int | None = 15) -> DataFrame:
    """source_id < target_id, n, weight of the pairs of nodes used in the same session: .3 at first, .02 more each time, at most 1.

    Of a session the nodes that were used most in it (uses, where there is such a column; then by id) take part, so many at most: an operator of the model, which bounds a session's pairs. Without
    such a number all take part; a large session is then cut into parts, of which each two meet in a task of their own.
    """
    keys = list(keys)
    if most is None:
        sizes = sessions.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_n"))
        some = sessions.join(sizes, keys).select(*keys, "node_id", F.pmod(F.xxhash64("node_id"), "_n").cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
        a = some.select(*keys, F.col("node_id").alias("source_id"), F.col("_own").alias("_a"), F.col("_other").alias("_b"))
        b = some.select(*keys, F.col("node_id").alias("target_id"), F.col("_other").alias("_a"), F.col("_own").alias("_b"))
        keys += ["_a", "_b"]
    else:
        order = Window.partitionBy(*keys).orderBy(*([F.desc("uses")] if "uses" in sessions.columns else []), "node_id")
        some = sessions.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")
        a = some.withColumnRenamed("node_id", "source_id")
        b = some.withColumnRenamed("node_id", "target_id")
    pairs = a.join(b, keys).filter("source_id < target_id").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("weight", F.least(F.lit(1.0), K.FIRST_CO_ACCESS + K.CO_ACCESS_STEP * (F.col("n") - 1)))


def undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select("source_id", "target_id", "weight").unionByName(pairs.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("total_weight"))


def strongest(edges: DataFrame, k: int = K.MAX_NEIGHBOURS) -> DataFrame:
    """Each node's k strongest edges, ties to the smaller neighbour."""
    order = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def roads(edges: DataFrame) -> DataFrame:
    """The edges that activation takes: each node's strongest over the least weight."""
    return strongest(edges.filter(F.col("weight") > K.MIN_EDGE)).select("source_id", "target_id", "weight")


def spread(seeds: DataFrame, edges: DataFrame, hops: int = K.MAX_HOPS) -> DataFrame:
    """query_id, id, activation: seeds start at 1 and push activation * weight * .5 ** (hop + 1) along their strongest edges.

    Synchronous: a hop pushes what was active (over .01) at its start. A fixed number of joins, no driver loop over data. A hop's rows are known before it is made, from
    the number of ways at each active node, and are dealt to as many tasks as keep each to SHARE rows.
    """
    ways = written(roads(edges), "roads")
    degree = written(ways.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("ways")), "ways")
    now = seeds.select("query_id", "id", F.lit(1.0).alias("activation"))
    for hop in range(hops):
        now = written(now, "spread")
        active = now.filter(F.col("activation") > K.MIN_ACTIVATION)
        rows = now.count() + (active.join(degree, "id").agg(F.sum("ways")).first()[0] or 0)
        tasks = max(1, -(-rows // SHARE), now.sparkSession.sparkContext.defaultParallelism)
        push = active.repartition(tasks, "id").join(ways.repartition(tasks, "source_id"), F.col("id") == F.col("source_id"))
        sent = push.select("query_id", F.col("target_id").alias("id"), (F.col("activation") * F.col("weight") * K.SPREAD_DECAY ** (hop + 1)).alias("activation"))
        now = now.unionByName(sent).repartition(tasks, "query_id", "id").groupBy("query_id", "id").agg(F.sum("activation").alias("activation"))
    return now


def bridges(edges: DataFrame, at_least: int = 2, k: int = 5, min_weight: float = 0.1, strongest_of: int = K.MAX_NEIGHBOURS) -> DataFrame:
    """Pairs without an edge that share at_least neighbours, each through its strongest edges; each node's k best by shared count."""
    e = strongest(edges.filter(F.col("weight") >= min_weight), strongest_of)
    a = e.select(F.col("source_id").alias("mid"), F.col("target_id").alias("a"))
    b = e.select(F.col("source_id").alias("mid"), F.col("target_id").alias("b"))
    shared = a.join(b, "mid").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= at_least)
    apart = shared.join(edges, (F.col("a") == F.col("source_id")) & (F.col("b") == F.col("target_id")), "left_anti")
    order = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return apart.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edges, F.col("id") == F.col("source_id"), "left_anti").join(edges, F.col("id") == F.col("target_id"), "left_anti")


def upsert_edges(old: DataFrame, new: DataFrame, first: float = 0.5, step: float = 0.1) -> DataFrame:
    """Edges after connecting new pairs: known ones gain a step for each time (at most 1), others start at first and gain for repeats."""
    n = new.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("times"))
    both = old.select("source_id", "target_id", "weight").join(n, ["source_id", "target_id"], "full_outer")
    weight = F.when(F.col("times").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.least(F.lit(1.0), first + step * (F.col("times") - 1))).otherwise(F.least(F.lit(1.0), F.col("weight") + step * F.col("times")))
    return both.select("source_id", "target_id", weight.alias("weight"), F.col("weight").isNull().alias("is_new"))


def unit(*what: Column | str) -> Column:
    """A number between 0 and 1 drawn by a hash of a name and of columns, the same in every run and engine."""
    name, *columns = what
    text = F.concat_ws(":", F.lit(name), *columns).cast("binary")
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def some_neighbours(edges: DataFrame, width: int = 10, seed: int = 7) -> DataFrame:
    """Each node's edges to so many of its neighbours, drawn with equal chances."""
    drawn = edges.select("source_id", "target_id", "weight", unit("way", "source_id", "target_id", F.lit(seed)).alias("_u"))
    order = Window.partitionBy("source_id").orderBy("_u", "target_id")
    return drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= width).drop("_u", "_r")


def random_walks(starts: DataFrame, edges: DataFrame, steps: int = 5, width: int = 10, seed: int = 7) -> DataFrame:
    """walk_id, path: weight-proportional walks along each node's strongest edges that do not revisit; a step that draws a visited node is spent.

    starts: id, and walk_id where walks are not named by their starts. Draws are hashes of walk, step and edge (Efraimidis-Spirakis keys), so walks are the same in every run.
    """
    ways = strongest(edges, width).select("source_id", "target_id", "weight")
    name = F.col("walk_id") if "walk_id" in starts.columns else F.col("id").alias("walk_id")
    now = starts.select(name, F.array("id").alias("path"), F.col("id").alias("at"))
    for step in range(steps):
        key = F.log(unit("step", "walk_id", "target_id", F.lit(step), F.lit(seed))) / F.col("weight")
        drawn = now.join(ways, F.col("at") == F.col("source_id"), "left").withColumn("key", F.when(F.col("target_id").isNotNull(), key))
        best = drawn.groupBy("walk_id", "path", "at").agg(F.max_by("target_id", F.struct("key", -F.col("target_id"))).alias("next"))
        fresh = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        now = best.select("walk_id", F.when(fresh, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), F.when(fresh, F.col("next")).otherwise(F.col("at")).alias("at"))
    return now.select("walk_id", "path")
