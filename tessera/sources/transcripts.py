"""Transcripts in JSON lines: polymorphic message contents, compaction markers, the newest file, and writes by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tail

#: What opens a user's message after a compaction: a fixed value.
CONTINUED = "continued from a previous conversation"
BLOCK = "struct<type:string,text:string,name:string,input:struct<file_path:string,command:string,pattern:string,description:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of whole files."""
    return messages(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def read_tails(spark: SparkSession, path: str, most: int = tail.TAIL_BYTES, marker: str = CONTINUED) -> DataFrame:
    """Messages at the ends of files, each after the newest marker that its own file's end holds in a user's message."""
    return since_marker(messages(tail.line_tails(spark, path, most)), marker, ("user",))


def messages(lines: DataFrame) -> DataFrame:
    """file, kind, ts, texts, tools (name, target) of every line (file, value) that is a message; malformed lines are left out.

    A message's content is a string or an array of blocks; both become arrays.
    """
    kind, stamp, content = (F.get_json_object("value", f"$.{x}") for x in ("type", "timestamp", "message.content"))
    rows = lines.select("file", kind.alias("kind"), F.try_to_timestamp(stamp).alias("ts"), content.alias("content")).filter(F.col("kind").isin("user", "assistant") & F.col("content").isNotNull())
    blocks = F.when(F.substring(F.ltrim("content"), 1, 1) == "[", F.from_json("content", f"array<{BLOCK}>")).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string,command:string,pattern:string,description:string>").alias("input"))))
    rows = rows.withColumn("blocks", F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")))
    texts = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), tool_target(b["input"]).alias("target")))
    return rows.select("file", "kind", "ts", texts.alias("texts"), tools.alias("tools"))


def tool_target(given: Column) -> Column:
    """What a tool call is about, on one line of at most 80 characters."""
    target = F.coalesce(given["file_path"], given["command"], given["pattern"], given["description"], F.lit(""))
    return F.substring(F.regexp_replace(target, r"\s+", " "), 1, 80)


def since_marker(messages: DataFrame, marker: str = "compact", kinds: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Messages after the newest one of their own file that holds the marker; all of a file where none does."""
    held = F.col("kind").isin(*kinds) & F.exists("texts", lambda t: F.contains(F.lower(t), F.lit(marker)))
    newest = messages.filter(held).groupBy("file").agg(F.max("ts").alias("_mark"))
    return messages.join(newest, "file", "left").filter(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark"))).drop("_mark").select(*messages.columns)


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """file, modified: the file of a folder that changed last."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"), F.max("modificationTime").alias("modified"))


def append(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Add rows to a log of Parquet files by date."""
    rows.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def trim(spark: SparkSession, path: str, keep_from: Column) -> DataFrame:
    """The rows of a log whose date is kept; whole partitions are pruned."""
    return spark.read.parquet(path).filter(F.col("date") >= keep_from)


def vectors_of(blobs: DataFrame, blob: str = "embedding") -> DataFrame:
    """Little-endian single-precision blobs as arrays."""

    def decode(column):
        import numpy as np
        import pandas as pd

        return pd.Series([None if b is None else np.frombuffer(b, "<f4").tolist() for b in column])

    return blobs.withColumn(blob, F.pandas_udf(decode, "array<float>")(blob))
