"""Tables in the folder that driver and executors share, and code for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set where everything runs in this one process, elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, what: str, *partitions: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partitions) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """What functions give that run jobs which do not need each other: the jobs are given to the cluster at the same time, so that the tail of one does not leave it idle."""
    with ThreadPoolExecutor(len(makers)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(f)) for f in makers]
        return [w.result() for w in waiting]


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if root not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, old) if x)
