"""Dreams: weighted seeds, walks that start from them in pairs, what their ends have to do with each other, and bridges proposed and matured.

Every draw is a hash of what it is drawn for, so that a dream is the same in every run and after a lost executor. Nights are parts of the store dealt by such a
hash: a night's pool is of bounded size, and the number of nights, not the size of a night, grows with the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import graph, insight
from tessera.sources.shared import written


def _first(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k)


def seeds(nodes: DataFrame, degrees: DataFrame, now: Column, nights: int, dreams: int = K.DREAMS, seed: int = 7) -> DataFrame:
    """night, dream (from 1), side (0 or 1), id: starts drawn by weight, none twice in a night.

    nodes: id, type, locked, archived, emotion, last_accessed; degrees: id, degree. Each night's pool is 35 of its open nodes and 5 of its locked ones of the types that
    take part; a start's weight is that of insight.seed_weight, a node never used counting as used a month ago. A pool that ends early gives fewer dreams.
    """
    live = nodes.filter(~F.col("archived") & (~F.col("locked") | F.col("type").isin(*K.DREAM_LOCKED_TYPES)))
    live = live.select("id", "locked", "emotion", "last_accessed", F.floor(graph.unit("night", "id", F.lit(seed)) * nights).cast("long").alias("night"), graph.unit("pool", "id", F.lit(seed)).alias("_u"))
    size = F.when(F.col("locked"), K.DREAM_POOL_LOCKED).otherwise(K.DREAM_POOL)
    rank = F.row_number().over(Window.partitionBy("night", "locked").orderBy("_u", "id"))
    pool = live.withColumn("_r", rank).filter(F.col("_r") <= K.DREAM_POOL).filter(F.col("_r") <= size).join(degrees.select("id", "degree"), "id", "left")
    days = F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_accessed").cast("timestamp"))) / 8.64e10, F.lit(30.0))
    weight = insight.seed_weight(F.col("degree"), F.coalesce("emotion", F.lit(0.0)), F.greatest(F.lit(0.0), days))
    drawn = _first(pool.withColumn("_key", F.log(graph.unit("seed", "id", F.lit(seed))) / weight), 2 * dreams, ["night"], F.desc("_key"), F.col("id"))
    place = F.col("_r") - 1
    both = drawn.select("night", (F.floor(place / 2) + 1).alias("dream"), (place % 2).alias("side"), "id")
    return both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("night", "dream"))).filter("_n = 2").drop("_n")


def dream(nodes: DataFrame, edges: DataFrame, now: Column, nights: int, dreams: int = K.DREAMS, steps: int = K.DREAM_STEPS, seed: int = 7) -> DataFrame:
    """night, dream, seed_a, seed_b, walk_a, walk_b, end_a, end_b, joined (an edge is between the ends), interest, surfaces, thought.

    Both walks draw among ten neighbours of a node, by weight, without going back. A dream surfaces from interest 4 on; the first of a night with 6 or more is a thought.
    edges: both directions. Ends that are one node have nothing in difference.
    """
    start = written(seeds(nodes, graph.degrees(edges.filter(F.col("weight") >= 0.1)), now, nights, dreams, seed), "dream-seeds")
    walk_id = (F.col("night") * dreams + F.col("dream") - 1) * 2 + F.col("side")
    ways = written(graph.some_neighbours(edges, K.DREAM_NEIGHBOURS, seed), "dream-ways")
    walks = graph.random_walks(start.select(walk_id.alias("walk_id"), "id"), ways, steps, K.DREAM_NEIGHBOURS, seed)
    at = start.select(walk_id.alias("walk_id"), "night", "dream", "side", "id").join(walks, "walk_id")
    one = lambda side, x: F.max(F.when(F.col("side") == side, F.col(x)))
    two = at.groupBy("night", "dream").agg(*(one(s, x).alias(f"{y}_{n}") for s, n in enumerate("ab") for x, y in (("id", "seed"), ("path", "walk"))))
    two = written(two.withColumns({f"end_{n}": F.element_at(f"walk_{n}", -1) for n in "ab"}), "dream-walks")
    about = nodes.select("id", "type", "project", "emotion", "last_accessed")
    for n in "ab":
        two = two.join(about.select(F.col("id").alias(f"end_{n}"), *(F.col(c).alias(f"{n}_{c}") for c in about.columns[1:])), f"end_{n}", "left")
    known = edges.select(F.col("source_id").alias("end_a"), F.col("target_id").alias("end_b")).distinct().withColumn("joined", F.lit(True))
    two = two.join(known, ["end_a", "end_b"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    two = two.withColumn("interest", insight.interest(two, now, F.size("walk_a") + F.size("walk_b")).cast("long"))
    night = Window.partitionBy("night").orderBy("dream").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("interest").over(night), F.lit(0))
    keep = ("night", "dream", "seed_a", "seed_b", "walk_a", "walk_b", "end_a", "end_b", "joined", "interest")
    return two.select(*keep, (F.col("interest") >= 4).alias("surfaces"), ((F.col("interest") >= 6) & (before < 6)).alias("thought"))


def intuitions(dreamt: DataFrame, nodes: DataFrame) -> DataFrame:
    """night, dream, type, title, content, emotion, targets: the node that a dream leaves where no edge joins its two ends, and the nodes it is linked with, by 0.3."""
    titles = nodes.select("id", "title")
    named = dreamt.filter(~F.col("joined") & (F.col("end_a") != F.col("end_b")))
    for at in ("seed_a", "end_a", "seed_b", "end_b"):
        named = named.join(titles.select(F.col("id").alias(at), F.col("title").alias(f"{at}_title")), at, "left")
    said = lambda c: F.coalesce(f"{c}_title", F.lit("?"))
    title = F.concat(F.lit("Dream: "), F.substring(said("end_a"), 1, 40), F.lit(" ↔ "), F.substring(said("end_b"), 1, 40))
    walk = lambda n: F.concat(F.lit('"'), said(f"seed_{n}"), F.lit('" → "'), said(f"end_{n}"), F.lit('"'))
    content = F.concat(F.lit("Association: "), walk("a"), F.lit(" | "), walk("b"))
    return named.select("night", "dream", F.lit("intuition").alias("type"), title.alias("title"), content.alias("content"), F.lit(0.2).alias("emotion"), F.array("end_a", "end_b").alias("targets"))


def proposals(candidates: DataFrame, edges: DataFrame, later: DataFrame, now: Column, each: int = K.DREAM_PROPOSALS, minutes: int = K.MATURATION_MINUTES) -> DataFrame:
    """source_id, target_id, night, matures_at, status of bridges proposed by dreams, at now.

    candidates: night, dream, source_id, target_id, at; edges: when they were proposed; later: now; both in both directions. Of a night's unjoined pairs the first few are proposed; a
    pair proposed before is not proposed again, while one that a night had no place for can be. After its minutes a proposal is created, or expired where an edge has come by itself. Nights are to lie these minutes
    apart or more, so that earlier proposals have matured and a night's few are all that is pending.
    """
    pair = [F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")]
    free = candidates.filter("source_id <> target_id").join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    rows = written(free.select("*", *pair, F.lit(None).cast("boolean").alias("_made")), "proposed")
    before = lambda *by: Window.partitionBy(*by).orderBy("night", "dream").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda made, *by: F.coalesce(F.sum(made.cast("int")).over(before(*by)), F.lit(0))
    # A row is decided as soon as the undecided ones before it make no difference; the first undecided one always is, and few rounds decide all.
    while not rows.filter("_made is null").isEmpty():
        sure, perhaps = F.coalesce("_made", F.lit(False)), F.coalesce("_made", F.lit(True))
        no = (earlier(sure, "_a", "_b") > 0) | (earlier(sure, "night") >= each)
        yes = (earlier(perhaps, "_a", "_b") == 0) & (earlier(perhaps, "night") < each)
        rows = written(rows.withColumn("_made", F.coalesce("_made", F.when(no, False).when(yes, True))), "proposed")
    made = rows.filter("_made")
    came = later.select("source_id", "target_id").distinct().withColumn("_came", F.lit(True))
    matures = F.col("at") + F.make_dt_interval(mins=F.lit(minutes))
    status = F.when(matures > now, "pending").when(F.col("_came"), "expired").otherwise("created")
    return made.join(came, ["source_id", "target_id"], "left").select("source_id", "target_id", "night", matures.alias("matures_at"), status.alias("status"))
