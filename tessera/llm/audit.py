"""Audit of how filters interact: what each removes at each place of each order that they can be applied in.

The orders of n filters share their beginnings, and a set of applied filters keeps the same documents in whatever order they came. So the trie of all orders is
walked depth first over 2 ** n states instead of n! paths: a state's survivors are persisted while its subtree is walked, every edge that
leaves it is counted on them, by one aggregation for all its edges, and a state that was seen before is not walked again. The counts
of all edges go to a table in the shared folder, and the rows of every order are read off from them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, stash, text_of

#: White space but the space itself.
BLANKS = "\t\n\x0b\x0c\r"
#: Filters of one audit: n! * n rows a part.
MOST = 7


def fewer_words(n: int):
    """Fails texts with fewer words."""
    return lambda text, words: F.size(words) < n


def distinct_below(percent: int):
    """Fails texts with a smaller share of distinct words."""
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def more_than(pattern: str, percent: int):
    """Fails texts in which a larger share of characters is of the pattern, one at a time."""
    return lambda text, words: 100 * F.regexp_count(text, F.lit(pattern)) > percent * F.length(text)


def holds(pattern: str):
    """Fails texts that hold the pattern."""
    return lambda text, words: text.rlike(pattern)


FILTERS = {"A": fewer_words(200), "B": distinct_below(50), "C": more_than("[A-Z]", 2), "D": holds("[#$%&*|]")}
#: The filter that compares documents.
COPIES = "E"


def flagged(docs: DataFrame, labels: DataFrame, filters=FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails_<letter> of every filter and of COPIES, good, toxic of every row of docs.

    A copy is a document whose text a smaller id has, too: all rows but those of the smallest id of a text. That id is found by an aggregation, and rows are joined with it
    by text and id at once, so that a text that many share is no hot key.
    """
    text, words = F.col("_text"), F.col("_words")
    digest, fails = F.unhex(F.sha2(text.cast("binary"), 256)), [f"fails_{f}" for f in filters]
    split = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_of(f"`{text_col}`").alias("_text")).withColumn("_words", split)
    read = stash(read.select("id", "part", digest.alias("digest"), *[f(text, words).alias(n) for n, f in zip(fails, filters.values())]), "audit-read")
    first = read.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    is_good, is_toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.select(F.col("doc_id").alias("id"), is_good.alias("good"), is_toxic.alias("toxic")).filter("id is not null and (good or toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = read.filter("id is not null").join(first, ["digest", "id"], "left").join(marks, "id", "left")
    own = [F.col("part"), *map(F.col, fails)]
    of = [F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("good", "toxic")]
    nameless = read.filter("id is null").select(*own, F.lit(False).alias(f"fails_{COPIES}"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.select(*own, F.col("_first").isNull().alias(f"fails_{COPIES}"), *of).unionByName(nameless)


def states(letters: str) -> Iterator[str]:
    """Every set of letters but the whole, as a sorted text."""
    for n in range(1 << len(letters)):
        if n < (1 << len(letters)) - 1:
            yield "".join(f for i, f in enumerate(letters) if n >> i & 1)


def count_edges(rows: DataFrame, letters: str) -> DataFrame:
    """part, state, kept, and removed_, good_, toxic_<letter> of each filter that is not in the state; parts without survivors have no row."""
    path, seen = f"{shared_dir(rows.sparkSession)}/audit-edges-{uuid.uuid4().hex}", set()
    measures = [f"{m}_{f}" for f in letters for m in ("removed", "good", "toxic")]

    def counted(survivors: DataFrame, state: str) -> DataFrame:
        out = [F.count(F.lit(1)).alias("kept")]
        for f in letters:
            fails = F.col(f"fails_{f}") if f not in state else F.lit(False)
            out += [F.count_if(fails).alias(f"removed_{f}"), F.count_if(fails & F.col("good")).alias(f"good_{f}"), F.count_if(fails & F.col("toxic")).alias(f"toxic_{f}")]
        return survivors.groupBy("part").agg(*out).select("part", F.lit(state).alias("state"), "kept", *measures)

    def walk(survivors: DataFrame, state: str) -> None:
        seen.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counted(survivors, state).write.mode("append").parquet(path)
        for f in letters:
            below = "".join(sorted({*state, f}, key=letters.index))
            if f not in state and below not in seen and len(below) < len(letters):
                walk(survivors.filter(~F.col(f"fails_{f}")), below)
        survivors.unpersist()

    walk(rows, "")
    return rows.sparkSession.read.schema(f"part string, state string, kept long, {', '.join(f'{m} long' for m in measures)}").parquet(path)


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order of the filters in every part.

    rows: part, fails_<letter> of each filter (none null), good, toxic; other columns are ignored. kept counts after the step; redundant are documents that fail the
    step's filter and went before; unique_fails fail this filter alone; shapley sums what the filter removes over all orders. Every part has
    all its rows, with zeros. No rows give no parts and an empty result. At most seven filters, for orders are as many as their factorial.
    """
    if len(letters) > MOST:
        raise ValueError(f"at most {MOST} filters")
    spark, n = rows.sparkSession, len(letters)
    rows = stash(rows.select("part", *[f"fails_{f}" for f in letters], "good", "toxic"), "audit-rows")
    counted = count_edges(rows, letters)
    every = F.explode(F.array(*[F.lit(s) for s in states(letters)])).alias("state")
    grid = counted.filter("state = ''").select("part", every)  # parts that a state has emptied count zero
    filled = grid.join(counted, ["part", "state"], "left").na.fill(0)
    edge = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), *[F.col(f"{m}_{f}").alias(m) for m in ("removed", "good", "toxic")]) for f in letters])).alias("e")
    edges = stash(filled.select("part", "state", "kept", edge).select("part", "state", "kept", "e.*").filter(~F.contains("state", "filter")), "audit-filled")
    weight = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(n - 1 - i)) for i in range(n)]), F.length("state") + 1)
    whole = edges.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.length("state") == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    steps = [("".join(o), i + 1, "".join(sorted(o[:i], key=letters.index)), o[i]) for o in permutations(letters) for i in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    met = edges.join(F.broadcast(orders), ["state", "filter"]).join(whole, ["part", "filter"])
    return met.select(
        "part", "filter_order", "step", (F.col("kept") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """The audit of these filters and of COPIES over documents, by their source (null: empty).

    A null text is empty, without words; so it fails what asks for a number of words, and a share of nothing is no failure. Null ids are no copies and have no labels; of repeated labels
    any good, and any toxic, one counts; of repeated rows each counts, those of one id and text are no copies of one another. Columns of other names are ignored. A very long text is split
    into words in one task.
    """
    return audit(flagged(docs, labels, filters), "".join(filters) + COPIES)
