"""Operators behind signals and reports: drains, arcs, comparisons, overlaps, budgets, templates, time phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.text import is_term
from tessera.sources.shared import written


def drained(rows: DataFrame, key: str, mark, n: int) -> DataFrame:
    """The next n rows after a mark; the largest key given is the next mark."""
    return rows.filter(F.col(key) > mark).orderBy(key).limit(n)


def arcs(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, n, arc: the values of each key in their order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x[value].cast("string")), ">").alias("arc"))


def compared(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Counts of each key in two tables, 0 where one has none."""
    of = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return of(a, names[0]).join(of(b, names[1]), key, "full_outer").select(key, *map(zero, names))


def promoted(found: DataFrame, missed: DataFrame) -> DataFrame:
    """before, after: the i-th worst unlocked result (id, locked, access_count) gives way to the i-th missed one. Both are short, ranked lists."""
    worst = found.filter("not locked").select("id", F.row_number().over(Window.orderBy("access_count", F.desc("id"))).alias("k"))
    new = missed.select(F.col("id").alias("new"), F.row_number().over(Window.orderBy("id")).alias("k"))
    return found.select("id").join(worst, "id", "left").join(new, "k", "left").select(F.col("id").alias("before"), F.coalesce("new", "id").alias("after"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, jaccard of two rankings' results."""
    each = a.select("query_id", "id").unionByName(b.select("query_id", "id")).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("query_id").agg((F.count_if(F.col("n") == 2) / F.count(F.lit(1))).alias("jaccard"))


def first_wins(sources: list[DataFrame]) -> DataFrame:
    """id, source: the union of short lists, each id with the first that has it."""
    marked = [df.select("id", F.lit(i).alias("source")) for i, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, marked).groupBy("id").agg(F.min("source").alias("source"))


def seed_weight(degree: Column, emotion: Column, age_days: Column) -> Column:
    """Weight of a node as the start of a walk: connected, felt and new ones first."""
    return F.sqrt(F.coalesce(degree, F.lit(0)) + 1) * (1 + 0.5 * emotion) * (1 + 1 / (1 + age_days))


def interest(pairs: DataFrame, now: Column, steps: Column) -> Column:
    """Interest of a connection between a_ and b_ nodes: recent use (0 to 3), other types (1), other projects (2), feeling (0 to 2), length of the walks (0 to 2)."""
    c = lambda x: (F.col(f"a_{x}"), F.col(f"b_{x}"))
    hours = scoring.hours_between(F.greatest(*c("last_accessed")), now)
    used = F.when(hours < 24, 3).when(hours < 72, 2).when(hours < 168, 1).otherwise(0)
    felt = F.greatest(*c("emotion"))
    return used + F.when(c("type")[0] != c("type")[1], 1).otherwise(0) + F.when(c("project")[0] != c("project")[1], 2).otherwise(0) + F.when(felt > 0.5, 2).when(felt > 0.3, 1).otherwise(0) + F.least(F.lit(2), F.floor(steps / 4))


def explicit_feedback(text: Column) -> Column:
    """positive, negative or neutral where a message opens with a phrase of feedback, else null."""
    low = F.lower(text)
    opens = lambda *words: reduce(lambda a, b: a | b, (low.startswith(w) for w in words))
    return F.when(opens("yes", "useful", "helpful"), "positive").when(opens("no", "not", "wrong"), "negative").when(opens("skip"), "neutral")


def injected(text: Column) -> Column:
    """Whether a message was put in by a program."""
    return text.rlike(r'^\s*(<[a-z-]+>|\[system|\{"type"|Caveat:)')


def templated(nodes: DataFrame) -> DataFrame:
    """Nodes with the title and content that their type's template gives."""
    content = F.when(F.length("content") > 80, F.concat(F.substring("content", 1, 77), F.lit("..."))).otherwise(F.col("content"))
    kind = F.concat(F.upper(F.substring("type", 1, 1)), F.substring("type", 2, 100))
    return nodes.withColumn("title", F.concat(kind, F.lit(": "), F.col("title"))).withColumn("content", content)


# What keywords are made of before words: proper nouns, camel case, snake case, dotted names; numbers with units.
NAMES = (r"[A-Z][a-zA-Z0-9]+(?:[._-][a-zA-Z0-9]+)*", r"[a-z]+[A-Z][a-zA-Z0-9]*", r"[a-z][a-z0-9]*_[a-z0-9_]+", r"[a-z]+(?:\.[a-z]+)+")
NUMBERS = r"(?i)\$?\d+(?:\.\d+)?%?(?:px|ms|s|d|kb|mb|gb)?"


def keywords(text: Column, most: int = 50) -> Column:
    """Names, then numbers with units, then words, each kind in order of its first place in the text, in lower case and with a form without signs; so many at most."""
    forms = lambda x: F.flatten(F.transform(x, lambda w: F.array(w, F.regexp_replace(w, "[^a-z0-9]", ""))))
    terms = lambda x: F.filter(x, is_term)
    names = terms(F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NAMES)), F.lower))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), F.lower)
    words = terms(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s./-]", " "), r"\s+"))
    long = lambda x: F.filter(forms(x), lambda w: F.length(w) > 2)
    return F.slice(F.array_distinct(F.concat(long(names), numbers, long(words))), 1, most)


def running(rows: DataFrame, order: list[Column], size: str, name: str = "filled") -> DataFrame:
    """rows with the sum of size up to each in a total order: summed within ranges of the order, to which what ranges before them hold is added.

    Only one row a range meets in one place.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = F.sum(size).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = ranged.groupBy("_range").agg(F.sum(size).alias("_own"))
    before = before.withColumn("_before", F.coalesce(F.sum("_own").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_own")
    return ranged.withColumn("_inside", inside).join(before, "_range").withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def within_budget(rows: DataFrame, order: list[Column], size: str, budget: int, exempt: Column) -> DataFrame:
    """Rows whose running size, in a total order, is within the budget, and exempt ones; filled: the size up to there."""
    return running(rows, order, size).filter(exempt | (F.col("filled") <= budget))


def synthesis(turns: DataFrame) -> DataFrame:
    """conv_id, turns, asked, flow (roles in order), last (text)."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.array_join(roles, ",").alias("flow"), F.max_by("text", "turn").alias("last"))


def session_health(nodes: DataFrame, key: str) -> DataFrame:
    """key, n, gaps (names, joined), overall of each session: what its new nodes (with evolution, links, access_count, validated_at) leave out."""
    c, kind = F.count_if, F.col("evolution")
    is_ = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    has = lambda x: F.bool_or(x).cast("int")
    dims = has(kind.isNull() & F.col("type").isin("rule", "lesson", "mechanism")) + has(is_("pattern")) + has((F.col("type") == "decision") | is_("hypothesis")) + has(is_("tension", "aspiration"))
    open_ = is_("tension", "hypothesis", "aspiration")
    s = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), dims.alias("dims"), c(is_("tension")).alias("corrections"), F.count("validated_at").alias("validations"), c(F.col("emotion") > 0.8).alias("quotes"),
        c(F.col("type") == "decision").alias("decisions"), F.count("confidence").alias("reasons"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
        c(open_ & (F.col("access_count") == 0)).alias("open_ones"), c(open_ & (F.col("access_count") > 0)).alias("acted"), F.avg(F.length("content")).alias("size"),
    )
    x = F.col
    found = {
        "encoding_diversity": x("dims") <= 2, "correction_honesty": (x("n") >= 8) & (x("corrections") == 0), "validation": (x("n") >= 5) & (x("validations") == 0), "operator_voice": (x("n") >= 5) & (x("quotes") == 0),
        "reasoning_preservation": (x("decisions") >= 2) & (x("reasons") == 0), "integration": (x("n") >= 5) & (x("links") < 2), "follow_through": (x("open_ones") >= 3) & (x("acted") == 0), "depth": (x("n") >= 5) & (x("size") < 80),
    }
    gaps = F.array_compact(F.array(*(F.when(v, k) for k, v in found.items())))
    overall = F.when(F.size(gaps) == 0, "healthy").when(F.size(gaps) <= 2, "some_gaps").otherwise("concerning")
    return s.select(key, "n", F.array_join(gaps, ",").alias("gaps"), overall.alias("overall"))


def maturity(counts: DataFrame) -> DataFrame:
    """score and stage of a store from one row of its counts: volume, depth, connectivity, self-awareness, reflection, partnership, diversity."""
    x, up = F.col, lambda v: F.least(F.lit(1.0), v)
    score = (
        up(x("n") / 500.0) * 0.10 + up(x("size") / 800) * 0.20 + up(x("edges") / F.greatest(F.lit(1.0), x("n") * 4.0)) * 0.10 + up(x("self") / F.greatest(F.lit(1.0), x("n") * 0.1)) * 0.20
        + up((x("corrections") + x("syntheses") + x("models")) / 20.0) * 0.20 + up((x("validations") + x("corrections")) / 15.0) * 0.15 + up(x("types") / 15.0) * 0.05
    )
    stage = F.when(x("n") < 10, "NEWBORN").when(score < 0.25, "COLLECTING").when(score < 0.5, "REFLECTING").when(score < 0.75, "PARTNERING").otherwise("INTEGRATED")
    return counts.select(score.alias("score"), stage.alias("stage"))
