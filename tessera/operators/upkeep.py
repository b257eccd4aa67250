"""Operators that keep a store in order: scopes, labels, risks, containment, rewiring, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring
from tessera.functions.text import tokens

# Commands that destroy something.
DESTRUCTIVE = (
    r"rm\s+(-[rf]+\s+|.*--force)", r"git\s+worktree\s+remove", r"git\s+reset\s+--hard", r"git\s+clean\s+-[fd]", r"git\s+checkout\s+--\s", r"git\s+push\s+.*--force",
    r"DROP\s+TABLE", r"DELETE\s+FROM", r"TRUNCATE", r"\brmdir\b", r"xargs\s+rm",
)
ENGINEERING, RULES = ("mechanism", "purpose", "impact", "vocabulary"), ("rule", "lesson", "constraint", "convention")


def in_scope(nodes: DataFrame, project: str) -> DataFrame:
    """Nodes of a project, and those that belong to none."""
    p = F.col("project")
    return nodes.filter((p == project) | p.isNull() | (p == ""))


def labels(nodes: DataFrame, now: Column) -> DataFrame:
    """id, freshness, priority, confidence, action_expected, feedback_needed."""
    hours, open_ = scoring.hours_between(F.col("created_at"), now), F.col("evolution").isNotNull()
    fresh = F.when(hours < 1, "just_now").when(hours < 24, "today").when(hours < 168, "this_week").when(hours < 720, "this_month").otherwise("older")
    rule = F.col("type").isin(*RULES)
    priority = F.when(F.col("locked") | open_, 0.9).when(F.col("type").isin(*ENGINEERING), 0.8).when(rule, 0.7).otherwise(0.5)
    sure = F.coalesce("confidence", F.when(F.col("locked"), 1.0).otherwise(0.7))
    return nodes.select("id", fresh.alias("freshness"), priority.alias("priority"), sure.alias("confidence"), (rule | F.col("locked") | (F.col("type") == "impact")).alias("action_expected"), open_.alias("feedback_needed"))


def risk(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """id, destructive, risk (none, low, high): texts (id, text) with destructive commands, high where they share a word with hot (w)."""
    marked = texts.withColumn("destructive", F.col("text").rlike("(?i)" + "|".join(DESTRUCTIVE)))
    words = marked.filter("destructive").select("id", F.explode(tokens(F.col("text"))).alias("w"))
    met = words.join(hot, "w", "left_semi").select("id").distinct().withColumn("met", F.lit(True))
    level = F.when(~F.col("destructive"), "none").when(F.col("met"), "high").otherwise("low")
    return marked.join(met, "id", "left").select("id", "destructive", level.alias("risk"))


def wildcard(column: Column, triggers) -> Column:
    """Whether a column contains any trigger, where * stands for anything."""
    return column.rlike("|".join(".*".join(part.replace(".", r"\.") for part in t.split("*")) for t in triggers))


def not_contained(items: DataFrame, id_col: str, text_col: str, texts: DataFrame, content: str, run: int = 3, key: str | None = None) -> DataFrame:
    """Items whose text, whatever its case, is a substring of none of the texts, which a hash names where they have no key.

    The inner words of an item keep their bounds inside any text that contains it, so a containing text shares their first run: an
    equi-join of hashes alone finds the candidates, whose texts are then fetched, each once, for the substring test. Items with too few inner words for a run
    are looked for in every text, as a small side that Spark broadcasts only within its limit.
    """
    asked = items.select(id_col, F.lower(text_col).alias("_item")).withColumn("_w", F.split("_item", r"\s+"))
    name = (F.col(key) if key else F.xxhash64(content)).alias("_key")
    long = asked.filter(F.size("_w") >= run + 2).select(id_col, "_item", F.xxhash64(F.slice("_w", 2, run)).alias("_run"))
    split = texts.select(name, F.split(F.lower(content), r"\s+").alias("_w"))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - run + 1)), lambda i: F.xxhash64(F.slice("_w", i, run)))
    runs = split.select("_key", F.explode(F.array_distinct(hashes)).alias("_run"))
    met = runs.join(long.select(id_col, "_run"), "_run").select("_key", id_col).distinct()
    low = texts.select(name, F.lower(content).alias("_low"))
    hit = met.join(low, "_key").join(long.select(id_col, "_item"), id_col).filter(F.contains("_low", "_item")).select(id_col)
    short = asked.filter((F.size("_w") < run + 2) & F.col("_item").isNotNull()).select(id_col, "_item")
    found = low.join(short, F.contains("_low", "_item")).select(id_col)
    return items.join(hit.unionByName(found).distinct(), id_col, "left_anti")


def rewired(edges: DataFrame, ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges with both ends moved by ids (old, new): loops go, of several the strongest stays, and none that exist already are given."""
    move = lambda df, end: df.join(ids.select(F.col("old").alias(end), F.col("new").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    moved = move(move(edges.select("source_id", "target_id", "weight"), "source_id"), "target_id").filter("source_id <> target_id")
    return moved.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight")).join(existing.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def protected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes beside an open tension, hypothesis or aspiration. edges: both directions."""
    open_ = nodes.filter("evolution in ('tension', 'hypothesis', 'aspiration') and not archived").select(F.col("id").alias("source_id"))
    return edges.join(open_, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()


def confidence_after(confidence: Column, event: str) -> Column:
    """Confidence (0.7 where unknown) after it was corrected, validated, diverged from, or had an impact."""
    c = F.coalesce(confidence, F.lit(0.7))
    return {
        "corrected": F.least(F.lit(1.0), F.greatest(F.lit(0.2), c * 0.7)),
        "validated": F.least(F.lit(1.0), c + 0.05),
        "diverged": F.greatest(F.lit(0.1), c - 0.2),
        "impact": F.least(F.lit(1.0), c + 0.1),
    }[event]


def evolution_states(nodes: DataFrame, age_days: Column) -> DataFrame:
    """Open evolutions with their status: confirmed, dismissed, resolved or active."""
    sure = (F.col("evolution") == "hypothesis") & (F.coalesce("confidence", F.lit(0.5)) >= 0.8)
    status = F.when(sure, "confirmed").when((age_days > 30) & (F.col("access_count") == 0), "dismissed").when((F.col("evolution") == "tension") & F.col("locked"), "resolved").otherwise("active")
    return nodes.filter("evolution is not null").withColumn("status", status)


def recent_before(accesses: DataFrame, hours: float, k: int) -> DataFrame:
    """event_id, source_id (its node), target_id: the k accesses of the same user before each access, within so many hours.

    Of each moment of a user the last k accesses count, and of all moments before one the last k that had any, so a window over moments
    gives the answer whatever number of accesses share a time, without a join of a user's accesses with themselves.
    """
    one = F.struct("ts", "event_id", "node_id")
    order = Window.partitionBy("user_id").orderBy("ts")
    within = Window.partitionBy("user_id", "ts").orderBy(F.desc("event_id"))
    few = accesses.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= k)
    moments = few.groupBy("user_id", "ts").agg(F.array_sort(F.collect_list(one)).alias("now"))
    before = F.flatten(F.collect_list("now").over(order.rowsBetween(-k, -1)))
    near = F.filter(before, lambda x: F.timestamp_diff("MICROSECOND", x["ts"], F.col("ts")) <= int(hours * 3.6e9))
    best = moments.select("user_id", "ts", F.slice(F.reverse(near), 1, k).alias("best"))
    met = accesses.join(best, ["user_id", "ts"])
    return met.select("event_id", F.col("node_id").alias("source_id"), F.explode("best").alias("x")).select("event_id", "source_id", F.col("x.node_id").alias("target_id"))


def recalibrated(nodes: DataFrame, age_days: Column, default: float = 0.7) -> DataFrame:
    """nodes with confidence after three passes: what was strongly felt cools, claims about the outside world decay by half in thirty days, well used nodes gain."""
    x, free = F.col, ~F.col("locked")
    felt = free & (x("emotion") > 0.6) & (age_days > 3)
    cooled = F.when(felt, F.greatest(F.lit(default * 0.7), x("confidence") * (1 - (0.05 + 0.1 * (x("emotion") - 0.6) / 0.4)))).otherwise(x("confidence"))
    claims = sum((F.contains(F.lower("content"), F.lit(w)).cast("int") for w in K.EXTERNAL_CLAIMS), F.lit(0))
    outside = free & (x("confidence") > 0.2) & (age_days > 7) & (claims >= 2)
    decayed = F.when(outside, F.least(x("confidence"), F.greatest(F.lit(max(0.2, default * 0.3)), default * F.pow(F.lit(0.5), age_days / 30)))).otherwise(x("confidence"))
    used = (x("access_count") >= 5) & (x("confidence") < 0.95) & F.coalesce(x("evolution") != "tension", F.lit(True))
    raised = F.when(used, F.greatest(x("confidence"), F.least(F.lit(min(0.95, default + 0.15)), x("confidence") + 0.03))).otherwise(x("confidence"))
    return nodes.withColumn("confidence", cooled).withColumn("confidence", decayed).withColumn("confidence", raised)


def suggest_score(activation: Column, kind: Column, locked: Column, neighbour: Column, text: Column, file_terms: list[str]) -> Column:
    """(activation, 0.5 where unknown, plus up to 0.15 by the file's terms that the text has) by type, lock and whether it came as a neighbour."""
    share = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in file_terms), F.lit(0)) / float(max(1, len(file_terms)))
    boost = F.when(kind == "rule", 1.3).when(kind == "decision", 1.2).otherwise(1.0) * F.when(locked, 1.5).otherwise(1.0) * F.when(neighbour, 0.85).otherwise(1.0)
    return (F.coalesce(activation, F.lit(0.5)) + 0.15 * share) * boost


def ingested(raw: DataFrame, now: Column, title: str = "title", content: str = "content") -> DataFrame:
    """New nodes with what is derived from them: default confidence by type, summary, lock of rules and decisions, keywords' number, and times."""
    from tessera.functions import text as T

    kind = F.col("type")
    default = F.when(kind.isin("rule", "decision", "lesson"), 0.9).when(kind == "context", 0.5).otherwise(0.7)
    return raw.select("id", "type", title, content, F.coalesce("confidence", default).alias("confidence"), kind.isin("rule", "decision").alias("locked"), T.summary(F.col(content)).alias("summary"), F.size(F.array_distinct(tokens(F.col(content)))).cast("long").alias("terms"), now.alias("created_at"))
