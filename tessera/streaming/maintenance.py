"""Upkeep of a store whenever it is idle: one run over what came in since the last one, steps in order, each on what the step before it left.

The store is a folder of table versions. Batch b of the stream reads version b and writes version b + 1, so a batch that is repeated after a failure
reads what it read before and writes the same tables again, and a run without new input changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text
from tessera.operators import resolve
from tessera.sources.shared import written

#: Accesses in a batch that make a node more stable, the factor, and its limit; accesses that lock a node; similarity of duplicates.
BOOSTED, FACTOR, MOST_STABLE, LOCKS, ALIKE = 3, 1.5, 10.0, 10, 0.85
TABLES = ("nodes", "edges", "log")


def used(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """Nodes with the accesses (node_id, ts) of the batch counted, and those used often more stable."""
    of = accesses.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    met = nodes.join(of, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    stable = F.when(F.col("_n") >= BOOSTED, F.least(F.lit(MOST_STABLE), F.col("stability") * FACTOR)).otherwise(F.col("stability"))
    out = met.withColumns({"stability": stable, "access_count": F.col("access_count") + F.col("_n"), "last_accessed": F.greatest("last_accessed", "_last")})
    return out.select(*nodes.columns)


def without_duplicates(nodes: DataFrame, edges: DataFrame, alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """Nodes with near-duplicates of locked ones archived, their accesses with the survivor, and edges moved to survivors."""
    live = nodes.filter("locked and not archived and embedding is not null")
    ids = written(resolve.merged(live.select("id", "embedding", "created_at"), alike, -F.unix_micros(F.col("created_at"))), "merged")
    gained = nodes.join(ids, nodes.id == ids.dropped).groupBy(F.col("kept").alias("id")).agg(F.sum("access_count").alias("_more"))
    out = nodes.join(gained, "id", "left").join(ids.select(F.col("dropped").alias("id"), F.lit(True).alias("_gone")), "id", "left")
    out = out.withColumns({"access_count": F.col("access_count") + F.coalesce("_more", F.lit(0)), "archived": F.col("archived") | F.coalesce("_gone", F.lit(False))})
    return out.select(*nodes.columns), resolve.merged_edges(edges, ids).select("source_id", "target_id", "weight")


def tended(nodes: DataFrame, edges: DataFrame, accesses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and a log (step, changed) after all steps: use, duplicates, locks, weak edges, summaries."""
    steps, before = [], nodes

    def noted(step: str, after: DataFrame, was: DataFrame, column: str) -> DataFrame:
        kept = written(after, step)
        changed = was.select("id", F.col(column).alias("_was")).join(kept.select("id", column), "id").filter(~F.col("_was").eqNullSafe(F.col(column)))
        steps.append(changed.agg(F.count(F.lit(1)).alias("changed")).select(F.lit(len(steps)).alias("place"), F.lit(step).alias("step"), "changed"))
        return kept

    nodes = noted("used", used(before, accesses), before, "access_count")
    merged, edges = without_duplicates(nodes, edges)
    edges = written(edges.filter(F.col("weight") > K.MIN_EDGE), "edges")
    nodes, before = noted("merged", merged, nodes, "archived"), nodes
    nodes, before = noted("locked", nodes.withColumn("locked", F.col("locked") | (~F.col("archived") & (F.col("access_count") >= LOCKS))), nodes, "locked"), nodes
    nodes = noted("summarised", nodes.withColumn("summary", F.coalesce("summary", text.summary(F.col("content")))), nodes, "summary")
    log = steps[0]
    for more in steps[1:]:
        log = log.unionByName(more)
    return nodes, edges, log


def begin(store: str, nodes: DataFrame, edges: DataFrame) -> None:
    """The first version of a store: nodes (id, content, summary, locked, archived, stability, access_count, last_accessed, created_at, embedding) and edges (source_id, target_id, weight)."""
    nodes.write.mode("overwrite").parquet(f"{store}/nodes/v0")
    edges.select("source_id", "target_id", "weight").write.mode("overwrite").parquet(f"{store}/edges/v0")


def version(spark: SparkSession, store: str, table: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{store}/{table}/v{n}")


def run(accesses: DataFrame, store: str) -> int:
    """Take in all accesses (a stream of node_id, ts) that are new, batch by batch, and return the version that the store is at afterwards."""

    def tend(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        for table, df in zip(TABLES, tended(version(spark, store, "nodes", n), version(spark, store, "edges", n), batch)):
            df.write.mode("overwrite").parquet(f"{store}/{table}/v{n + 1}")

    query = accesses.writeStream.foreachBatch(tend).trigger(availableNow=True).option("checkpointLocation", f"{store}/checkpoint").start()
    query.awaitTermination()
    last = query.lastProgress
    return (last["batchId"] + 1 if last and last["numInputRows"] else last["batchId"]) if last else 0
