"""Helpers shared by the training-data operators: shared storage, tables, small column tools."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words: one or more of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset and everything runs in this one process (tests), a temporary folder is set instead;
    on a cluster a missing setting is an error, for a local folder would be different on each machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that no later step reads."""
    spark, path = df.sparkSession, df.stashed_at
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


#: Arrow batches of texts are bounded by bytes, not only by rows, so that very long texts do not add up in a Python worker.
BATCH_BYTES = 4 << 20
#: Python workers give memory back between batches instead of keeping what their largest one took.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, in bounded memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if root not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, old) if x)
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
