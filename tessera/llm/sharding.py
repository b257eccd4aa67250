"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a gapless global number: rows fall into buckets by a hash of their identity, a prefix sum over the
bucket counts (one row per bucket) gives each bucket its first number, and a window inside each bucket the rest.
The permutation is a Feistel network over the mixed radix a * b >= n with a = ceil(sqrt(n)); a result of n or more is
sent through the network again (cycle walking), so the permutation is a bijection of 0..n-1. The permuted number p
gives shard p mod k and slot p div k, computable for any row number without touching the data.

Equal rows (same id, size and text checksum) are counted first and expanded last, so that no repeated row, however
frequent, is sorted or shuffled by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 4
#: Walks that the expression tries beyond the first pass; the chance that a row needs more is under n ** -(WALKS / 2).
WALKS = 40
#: Numbers of a repeated row that one task makes at once.
RANGE = 65_536


def _div(x: Column, k: int) -> Column:
    """Whole division of longs, exact beyond 2 ** 53."""
    return F.call_function("div", x, F.lit(k).cast("long"))


def _hashed(x: Column, key: int) -> Column:
    """48 bits of an MD5 sum: a hash that other engines have as well."""
    digits = F.substring(F.md5(F.concat_ws(":", x.cast("string"), F.lit(key).cast("string")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long")


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over pairs (left < a, right < b), numbered left * b + right."""
    right = F.pmod(x, F.lit(b)).cast("long")
    left = _div(x - right, b)
    for i in range(ROUNDS):
        key = seed * 1_000 + i
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(_hashed(right, key), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(_hashed(left, key), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number x (0 <= x < n) in the shuffle: a bijection of 0..n-1 for each seed."""
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    once = _network(x, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed)))
    out = F.when(once < n, once).otherwise(walked)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into shards under the law `rows`: shard counts are at most one apart and slots have no gaps.

    Returns id_col, size (UTF-8 bytes of the text plus 1), text_crc32, row_number, position, law, shard, slot,
    grown_shard (null under this law). A null text has size 1 and checksum 0, as the empty one; very long texts are measured where they
    are read; a null id is dealt like any other; rows of equal id, size and checksum are told apart by nothing else, so their places are theirs in any order; repeated rows each get a place; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    kinds = rows.groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    kinds = kinds.withColumn("bucket", F.pmod(_hashed(F.concat_ws(":", F.col(id_col).cast("string"), "size", "text_crc32"), seed), F.lit(buckets)).cast("int"))
    # One row per bucket, so this window and the broadcast are bounded by the number of buckets.
    filled = kinds.groupBy("bucket").agg(F.sum("copies").alias("filled"))
    firsts = filled.select("bucket", (F.sum("filled").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("filled")).alias("first"))
    n = docs.count()
    order = Window.partitionBy("bucket").orderBy(F.col(id_col), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        kinds.withColumn("upto", F.sum("copies").over(order))
        .join(F.broadcast(firsts), "bucket")
        .withColumn("start", F.col("first") + F.col("upto") - F.col("copies"))
        # A row that is repeated very often becomes ranges of numbers first, dealt out, so that no task makes all of its rows.
        .select(id_col, "size", "text_crc32", (F.col("start") + F.col("copies")).alias("end"), F.explode(F.expr(f"sequence(start, start + copies - 1, {RANGE}L)")).alias("from"))
        .repartition("from")
        .select(id_col, "size", "text_crc32", F.explode(F.expr(f"sequence(from, least(from + {RANGE}, end) - 1)")).alias("row_number"))
    )
    placed = numbered.withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.select(
        id_col, "size", "text_crc32", "row_number", "position",
        F.lit("rows").alias("law"),
        F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("position"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
