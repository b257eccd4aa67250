"""Queries on signals, health, activity over time, retrieval quality and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring
from tessera.operators import activity, embedding, feedback, graph, insight, matches, terms
from tessera.plans.network import NOW, ago
from tessera.plans.registry import query, r6, whole
from tessera.plans.retrieval import CONFIDENT, COUNTS, IDF, NEAR, TF, TFIDF, near, round_sql, sentences_sql, tokens_sql
from tessera.sources.fixtures import Memory
from tessera.sources.shared import written

ERRORS = "errors AS (SELECT event_id, user_id, ts, k % 10 AS pattern FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error')"


def errors(m: Memory):
    k = F.get_json_object("props", "$.k").cast("long")
    return m.table("events").filter("event_type = 'error'").select("event_id", "user_id", "ts", (k % 10).alias("pattern"))


@query(f"""SELECT id, type, title, access_count FROM nodes WHERE NOT locked AND NOT archived AND access_count >= 3 AND type NOT IN ('context', 'thought', 'intuition')
    AND last_accessed < {NOW} - INTERVAL 3 DAY ORDER BY access_count DESC, id LIMIT 5""", "nodes")
def q_fading(m):
    """Much used nodes that no one used lately (days as the fixture's month needs)."""
    old = m.nodes.filter("not locked and not archived and access_count >= 3 and type not in ('context', 'thought', 'intuition')").filter(F.col("last_accessed") < ago(3))
    return old.orderBy(F.desc("access_count"), "id").limit(5).select("id", "type", "title", "access_count")


@query(f"SELECT count(*) AS n FROM nodes WHERE type = 'context' AND NOT archived AND created_at < {NOW} - INTERVAL 7 DAY", "nodes")
def q_stale_context(m):
    return m.bare_nodes.filter("type = 'context' and not archived").filter(F.col("created_at") < ago(7)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ERRORS} SELECT pattern, count(*) AS n, max(ts) AS latest FROM errors WHERE ts > {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 3")
def q_miss_trends(m):
    recent = errors(m).filter(F.col("ts") > ago(7)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
    return recent.filter("n >= 2").orderBy(F.desc("n"), "pattern").limit(3)


@query("""WITH top AS (SELECT project, count(*) AS n FROM nodes WHERE NOT archived AND project IS NOT NULL GROUP BY 1 ORDER BY n DESC, project LIMIT 5)
    SELECT max(n) AS largest, min(n) AS smallest, max(n) > 10 * min(n) AS shifted FROM top""", "nodes")
def q_density_shift(m):
    top = m.bare_nodes.filter("not archived and project is not null").groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(5)
    return top.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") > 10 * F.min("n")).alias("shifted"))


RECENT, OLDER = f"emotion > 0 AND created_at > {NOW} - INTERVAL 3 DAY", f"emotion > 0 AND created_at BETWEEN {NOW} - INTERVAL 10 DAY AND {NOW} - INTERVAL 3 DAY"


@query(f"""WITH x AS (SELECT coalesce(avg(emotion) FILTER (WHERE {RECENT}), 0) AS recent, count(*) FILTER (WHERE {RECENT}) AS n, coalesce(avg(emotion) FILTER (WHERE {OLDER}), 0) AS older FROM nodes)
    SELECT {round_sql('recent')} AS recent, {round_sql('older')} AS older, n, CASE WHEN n >= 5 AND recent > older + 0.15 THEN 'increasing' WHEN n >= 5 AND recent < older - 0.15 THEN 'decreasing' ELSE 'steady' END AS trend FROM x""", "nodes")
def q_emotion_trend(m):
    felt = F.col("emotion") > 0
    recent, older = felt & (F.col("created_at") > ago(3)), felt & F.col("created_at").between(ago(10), ago(3))
    zero = lambda c: F.coalesce(F.avg(F.when(c, F.col("emotion"))), F.lit(0.0))
    x = m.bare_nodes.agg(zero(recent).alias("recent"), F.count_if(recent).alias("n"), zero(older).alias("older"))
    trend = F.when((F.col("n") >= 5) & (F.col("recent") > F.col("older") + 0.15), "increasing").when((F.col("n") >= 5) & (F.col("recent") < F.col("older") - 0.15), "decreasing").otherwise("steady")
    return x.select(r6("recent"), r6("older"), "n", trend.alias("trend"))


@query(f"""SELECT project, {round_sql(f'coalesce(avg(emotion) FILTER (WHERE created_at > {NOW} - INTERVAL 7 DAY), 0.3::DOUBLE)')} AS recent, {round_sql(f'coalesce(avg(emotion) FILTER (WHERE created_at <= {NOW} - INTERVAL 7 DAY AND created_at > {NOW} - INTERVAL 30 DAY), 0.3::DOUBLE)')} AS older
    FROM nodes WHERE NOT archived GROUP BY 1""", "nodes")
def q_emotion_trend_project(m):
    new = F.col("created_at") > ago(7)
    mean = lambda c, name: r6(F.coalesce(F.avg(F.when(c, F.col("emotion"))), F.lit(0.3)), name)
    return m.bare_nodes.filter("not archived").groupBy("project").agg(mean(new, "recent"), mean(~new & (F.col("created_at") > ago(30)), "older"))


@query(f"""SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS passes, {round_sql('avg(value)')} AS mean FROM events GROUP BY 1""")
def q_json_trends(m):
    k = F.get_json_object("props", "$.k").cast("long")
    return m.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.count_if(k >= 50).alias("passes"), r6(F.avg("value"), "mean"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) FILTER (WHERE event_type <> 'error') AS passes, count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY 1 HAVING passes > 0 AND failures > 0""")
def q_flaky(m):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    bad = F.col("event_type") == "error"
    return m.table("events").groupBy(k).agg(F.count_if(~bad).alias("passes"), F.count_if(bad).alias("failures")).filter("passes > 0 and failures > 0")


@query("SELECT type, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE NOT archived) AS active, count(*) FILTER (WHERE archived) > count(*) FILTER (WHERE NOT archived) AS decaying FROM nodes GROUP BY 1 HAVING count(*) >= 3", "nodes")
def q_decay_patterns(m):
    gone = F.count_if(F.col("archived"))
    kept = F.count_if(~F.col("archived"))
    return m.bare_nodes.groupBy("type").agg(gone.alias("archived"), kept.alias("active"), (gone > kept).alias("decaying"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("n")


@query(f"SELECT type, count(*) AS n FROM nodes WHERE access_count = 0 AND NOT archived AND created_at < {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 5", "nodes")
def q_never_accessed(m):
    unused = m.nodes.filter("access_count = 0 and not archived").filter(F.col("created_at") < ago(7))
    return unused.groupBy("type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query(f"WITH {ERRORS} SELECT pattern, count(*) AS n, max(ts) AS latest, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM errors GROUP BY 1 HAVING count(*) >= 3")
def q_recurring_patterns(m):
    return errors(m).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.array_join(F.array_sort(F.collect_set("user_id")), ",").alias("users")).filter("n >= 3")


@query(f"SELECT event_type AS signal, {round_sql('CASE WHEN count(*) >= 3 THEN count(*) FILTER (WHERE value > 50) / CAST(count(*) AS DOUBLE) ELSE 0.5 END')} AS rate FROM events GROUP BY 1")
def q_engagement(m):
    """Share of the responses to each signal that were a yes; even until three are known."""
    n = F.count(F.lit(1))
    return m.table("events").groupBy(F.col("event_type").alias("signal")).agg(r6(F.when(n >= 3, F.count_if(F.col("value") > 50) / n).otherwise(0.5), "rate"))


@query("SELECT type, id, position FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id) AS position FROM nodes WHERE NOT archived) WHERE position <= 3", "nodes")
def q_latest_per_type(m):
    order = Window.partitionBy("type").orderBy(F.desc("created_at"), "id")
    return m.bare_nodes.filter("not archived").withColumn("position", F.row_number().over(order)).filter("position <= 3").select("type", "id", whole("position"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def q_confusion_matrix(m):
    return m.table("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, type, title FROM nodes WHERE NOT archived AND type IN ('mechanism', 'lesson') AND coalesce(confidence, 0.7) > 0.5 AND (last_accessed IS NULL OR last_accessed < {NOW} - INTERVAL 21 DAY) ORDER BY access_count DESC, id LIMIT 3", "nodes")
def q_stale_reasoning(m):
    old = m.nodes.filter("not archived and type in ('mechanism', 'lesson') and coalesce(confidence, 0.7D) > 0.5D").filter(F.col("last_accessed").isNull() | (F.col("last_accessed") < ago(21)))
    return old.orderBy(F.desc("access_count"), "id").limit(3).select("id", "type", "title")


@query(f"SELECT id, title, last_accessed FROM nodes WHERE NOT archived AND confidence >= 0.8 AND last_accessed > {NOW} - INTERVAL 7 DAY ORDER BY last_accessed DESC, id LIMIT 3", "nodes")
def q_validated(m):
    return m.nodes.filter("not archived and confidence >= 0.8D").filter(F.col("last_accessed") > ago(7)).orderBy(F.desc("last_accessed"), "id").limit(3).select("id", "title", "last_accessed")


HEALTH_SQL = f"""WITH e AS (SELECT source_id AS id, count(*) AS links FROM coaccess GROUP BY 1), s AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n,
    (bool_or(evolution IS NULL AND type IN ('rule', 'lesson', 'mechanism')))::INT + (bool_or(coalesce(evolution = 'pattern', false)))::INT + (bool_or(type = 'decision' OR coalesce(evolution = 'hypothesis', false)))::INT + (bool_or(coalesce(evolution IN ('tension', 'aspiration'), false)))::INT AS dims,
    count(*) FILTER (WHERE evolution = 'tension') AS corrections, count(validated_at) AS validations, count(*) FILTER (WHERE emotion > 0.8) AS quotes, count(*) FILTER (WHERE type = 'decision') AS decisions, count(confidence) AS reasons, sum(coalesce(links, 0))::BIGINT AS links,
    count(*) FILTER (WHERE evolution IN ('tension', 'hypothesis', 'aspiration') AND access_count = 0) AS open_ones, count(*) FILTER (WHERE evolution IN ('tension', 'hypothesis', 'aspiration') AND access_count > 0) AS acted, avg(length(content)) AS size
    FROM nodes LEFT JOIN e USING (id) WHERE NOT archived GROUP BY 1 HAVING count(*) >= 3),
    g AS (SELECT day, n, [CASE WHEN dims <= 2 THEN 'encoding_diversity' END, CASE WHEN n >= 8 AND corrections = 0 THEN 'correction_honesty' END, CASE WHEN n >= 5 AND validations = 0 THEN 'validation' END, CASE WHEN n >= 5 AND quotes = 0 THEN 'operator_voice' END,
        CASE WHEN decisions >= 2 AND reasons = 0 THEN 'reasoning_preservation' END, CASE WHEN n >= 5 AND links < 2 THEN 'integration' END, CASE WHEN open_ones >= 3 AND acted = 0 THEN 'follow_through' END, CASE WHEN n >= 5 AND size < 80 THEN 'depth' END] AS found FROM s),
    h AS (SELECT day, n, list_filter(found, lambda x: x IS NOT NULL) AS gaps FROM g)
    SELECT day, n, array_to_string(gaps, ',') AS gaps, CASE WHEN len(gaps) = 0 THEN 'healthy' WHEN len(gaps) <= 2 THEN 'some_gaps' ELSE 'concerning' END AS overall FROM h"""


@query(HEALTH_SQL, "nodes", "coaccess")
def q_session_health(m):
    """Eight dimensions of what each day encoded, and what is missing."""
    links = graph.co_access(m.sessions).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return insight.session_health(m.nodes.filter("not archived").join(links, "id", "left").withColumn("day", F.to_date("created_at")), "day").filter("n >= 3")


MATURITY_SQL = f"""WITH n AS (SELECT count(*) AS n, avg(length(content)) AS size, count(*) FILTER (WHERE project = 'src0') AS self, count(*) FILTER (WHERE type = 'concept') AS models, count(validated_at) AS validations, count(DISTINCT type) AS types FROM nodes WHERE NOT archived),
    o AS (SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM events WHERE event_type = 'error' AND ts > {NOW} - INTERVAL 2 DAY) AS corrections, (SELECT count(DISTINCT conv_id) FROM conversations) AS syntheses),
    s AS (SELECT n, least(1.0::DOUBLE, n / 500.0::DOUBLE) * 0.10::DOUBLE + least(1.0::DOUBLE, size / 800) * 0.20::DOUBLE + least(1.0::DOUBLE, edges / greatest(1.0::DOUBLE, n * 4.0::DOUBLE)) * 0.10::DOUBLE + least(1.0::DOUBLE, self / greatest(1.0::DOUBLE, n * 0.1::DOUBLE)) * 0.20::DOUBLE
        + least(1.0::DOUBLE, (corrections + syntheses + models) / 20.0::DOUBLE) * 0.20::DOUBLE + least(1.0::DOUBLE, (validations + corrections) / 15.0::DOUBLE) * 0.15::DOUBLE + least(1.0::DOUBLE, types / 15.0::DOUBLE) * 0.05::DOUBLE AS score FROM n, o)
    SELECT {round_sql('score')} AS score, CASE WHEN n < 10 THEN 'NEWBORN' WHEN score < 0.25 THEN 'COLLECTING' WHEN score < 0.5 THEN 'REFLECTING' WHEN score < 0.75 THEN 'PARTNERING' ELSE 'INTEGRATED' END AS stage FROM s"""


@query(MATURITY_SQL, "nodes", "edges")
def q_maturity(m):
    """Seven dimensions of the store's growth, weighted, and its stage."""
    number = F.count(F.lit(1))
    kept = m.bare_nodes.filter("not archived").agg(number.alias("n"), F.avg(F.length("content")).alias("size"), F.count_if(F.col("project") == "src0").alias("self"), F.count_if(F.col("type") == "concept").alias("models"), F.count("validated_at").alias("validations"), F.count_distinct("type").alias("types"))
    links = graph.undirected(graph.co_access(m.sessions)).agg(number.alias("edges"))
    wrong = m.table("events").agg(F.count_if((F.col("event_type") == "error") & (F.col("ts") > ago(2))).alias("corrections"))
    talks = m.turns.agg(F.count_distinct("conv_id").alias("syntheses"))
    one = kept
    for other in (links, wrong, talks):  # one row each
        one = one.join(F.broadcast(other), F.lit(True))
    return insight.maturity(one).select(r6("score"), "stage")


@query(f"SELECT project, count(*) AS n, sum(length(content))::BIGINT AS chars, {round_sql('avg(length(content))')} AS mean FROM nodes GROUP BY 1", "nodes")
def q_encoding_depth(m):
    size = F.length("content")
    return m.bare_nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("chars"), r6(F.avg(size), "mean"))


@query("""WITH g AS (SELECT *, CASE WHEN CAST(ts AS DATE) <> CAST(p AS DATE) OR epoch_us(ts) - epoch_us(p) > 7200000000 OR p IS NULL THEN 1 ELSE 0 END AS opens FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::INTEGER AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def q_gap_sessions(m):
    return activity.gap_sessions(m.table("events"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS started, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def q_density_windows(m):
    return activity.tumbling(m.table("events"))


@query("SELECT started, n, errors FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS started, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) WHERE n >= 3 AND errors < 0.15 * n")
def q_sparse_windows(m):
    return activity.tumbling(m.table("events")).filter((F.col("n") >= 3) & (F.col("errors") < 0.15 * F.col("n")))


@query("""SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def q_turn_pairs(m):
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = m.turns.select("conv_id", "turn", "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"))
    return both.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "next_turn")


@query("""WITH b AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events),
    c AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS since FROM b)
    SELECT event_id, user_id, since, CASE WHEN since >= 15 THEN 'urgent' ELSE 'nudge' END AS severity FROM c WHERE since >= 8""")
def q_heartbeat(m):
    """Events since the user's last mark, where they are many."""
    counted = activity.since_mark(m.table("events"), F.col("event_type") == "error").filter("since >= 8")
    return counted.select("event_id", "user_id", whole("since"), F.when(F.col("since") >= 15, "urgent").otherwise("nudge").alias("severity"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, CASE row_number() OVER (ORDER BY day DESC) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM d)
    SELECT day, n, weight, CAST(floor(10000 * weight / sum(weight) OVER () + 1e-9) AS BIGINT) AS budget FROM w""")
def q_budget_weights(m):
    daily = m.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return activity.budgets(daily, "day", 10_000)


@query(f"SELECT node_id, count(*) AS n FROM accesses WHERE ts > {NOW} - INTERVAL 48 HOUR GROUP BY 1 HAVING count(*) >= 3", "accesses")
def q_lookback(m):
    return m.accesses.filter(F.col("ts") > ago(2)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


RANKED = f"""{NEAR}, ranked AS (SELECT r.query_id, r.rank, r.id, a.label = b.label AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near) r
    JOIN vectors a ON a.id = r.query_id JOIN vectors b ON b.id = r.id WHERE rank <= 10),
    cum AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranked),
    quality AS (SELECT query_id, count(*) FILTER (WHERE hit) / 10.0::DOUBLE AS precision, coalesce(max(CASE WHEN hit THEN 1.0::DOUBLE / rank END), 0) AS reciprocal,
        coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg, coalesce(sum(CASE WHEN hit THEN hits / CAST(rank AS DOUBLE) END), 0) AS summed, count(*) FILTER (WHERE hit) AS found FROM cum GROUP BY 1),
    ideal AS (SELECT sum(1 / log2(x + 1)) AS best FROM range(1, 11) t(x))"""


def quality(m: Memory):
    """query_id, precision, reciprocal, dcg, summed, found of the ten nearest, relevant if of the query's label."""
    labels = m.vectors.select("id", "label")
    asked = labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = near(m, 10).join(labels, "id").join(asked, "query_id").withColumn("hit", F.col("label") == F.col("wanted"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranked.withColumn("hits", F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(upto))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return cum.groupBy("query_id").agg(
        (F.count_if("hit") / 10.0).alias("precision"),
        zero(F.max(F.when(F.col("hit"), 1.0 / F.col("rank")))).alias("reciprocal"),
        zero(F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0)))).alias("dcg"),
        zero(F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank")))).alias("summed"),
        F.count_if("hit").alias("found"),
    )


@query(f"WITH {RANKED} SELECT query_id, {round_sql('precision')} AS precision, {round_sql('reciprocal')} AS reciprocal, {round_sql('dcg / best')} AS ndcg, {round_sql('CASE WHEN found = 0 THEN 0 ELSE summed / found END')} AS average_precision FROM quality, ideal", "vectors")
def q_retrieval_quality(m):
    """Precision at ten, reciprocal rank, nDCG and average precision of each query."""
    from math import log2

    ideal = sum(1 / log2(i + 1) for i in range(1, 11))
    average = F.when(F.col("found") == 0, 0.0).otherwise(F.col("summed") / F.col("found"))
    return quality(m).select("query_id", r6("precision"), r6("reciprocal"), r6(F.col("dcg") / ideal, "ndcg"), r6(average, "average_precision"))


@query(f"WITH {RANKED} SELECT count(*) AS n, {round_sql('avg(precision)')} AS mean, {round_sql('min(precision)')} AS least, {round_sql('max(precision)')} AS most, {round_sql('stddev_pop(precision)')} AS spread, {round_sql('avg(reciprocal)')} AS mrr FROM quality", "vectors")
def q_ir_aggregate(m):
    return quality(m).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("precision"), "mean"), r6(F.min("precision"), "least"), r6(F.max("precision"), "most"), r6(F.stddev_pop("precision"), "spread"), r6(F.avg("reciprocal"), "mrr"))


@query(f"""WITH {NEAR}, base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS before FROM near) WHERE before <= 20),
    moved AS (SELECT query_id, b.id, before, row_number() OVER (PARTITION BY query_id ORDER BY round(score * {CONFIDENT}, 9) DESC, b.id) AS after FROM base b JOIN nodes n ON b.id = n.id)
    SELECT query_id, id, before, after FROM moved WHERE abs(before - after) > 3""", "vectors", "nodes")
def q_rank_shift(m):
    """Results whose rank moves by more than three once confidence weighs in."""
    base = near(m, 20).withColumnRenamed("rank", "before").join(m.bare_nodes.select("id", "confidence"), "id")
    score = F.round(F.col("score") * scoring.confidence_multiplier(F.col("confidence")), 9)
    moved = base.withColumn("after", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id")))
    return moved.filter(F.abs(F.col("before") - F.col("after")) > 3).select("query_id", "id", whole("before"), whole("after"))


def found_sql(patterns) -> str:
    return "(" + " + ".join("CASE WHEN regexp_matches(lower(text), '{}') THEN 1 ELSE 0 END".format(p.replace("'", "''")) for p in patterns) + ")::BIGINT"


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


OPENER = r"regexp_replace(split_part(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ', 1), '[,.:;!?—–-]', '', 'g')"
SIGNALS = f"""said AS (SELECT conv_id, turn, text, {', '.join(f'{found_sql(p)} AS {n}' for n, p in K.FEEDBACK.items())},
    CASE WHEN {OPENER} IN {listed(K.OPENS_POSITIVE)} THEN 'positive' WHEN {OPENER} IN {listed(K.OPENS_NEGATIVE)} THEN 'negative' WHEN {OPENER} IN {listed(K.OPENS_TRANSITION)} THEN 'transition' ELSE 'none' END AS opens
    FROM conversations WHERE role = 'user')"""


def followups(m: Memory):
    return feedback.signals(m.turns.filter("role = 'user'").select("conv_id", "turn", "text"))


@query(f"WITH {SIGNALS} SELECT * EXCLUDE (text) FROM said")
def q_followup_signals(m):
    return followups(m).drop("text")


SIGN = " , ".join(f"1.0::DOUBLE - 2 * (((strpos('0123456789abcdef', substr(digest, {i // 4 + 1}, 1)) - 1) >> {i % 4}) & 1)" for i in range(embedding.DIMS))
LONG_SENTENCES = f"list_filter(coalesce({sentences_sql('{0}')}, []), lambda s: length(trim(s)) > {embedding.SENTENCE})"


def embedded_sql(rows: str, name: str) -> str:
    """name (id, v): hashed TF-IDF of the texts in rows (id, text), under the frequencies in idf."""
    return f"""{name}_c AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest({tokens_sql('text')}) AS term FROM {rows}) GROUP BY 1, 2),
    {name}_w AS (SELECT id, term, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY id)) * (ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1) AS w FROM {name}_c LEFT JOIN idf USING (term)),
    {name}_s AS (SELECT term, [{SIGN}] AS s FROM (SELECT DISTINCT term, md5(term || ':0') AS digest FROM {name}_w)),
    {name}_x AS (SELECT id, list(x ORDER BY i) AS x FROM (SELECT id, i, sum(w * s[i]) AS x FROM {name}_w JOIN {name}_s USING (term), range(1, {embedding.DIMS + 1}) r(i) GROUP BY 1, 2) GROUP BY 1),
    {name} AS (SELECT id, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) AS v FROM {name}_x WHERE list_inner_product(x, x) > 0)"""


MEASURED = f"""{COUNTS}, {TF}, {IDF}, turned AS (SELECT conv_id, turn, text, role, lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS response, lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS followup, lead(turn, 2) OVER w AS fup_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    asking AS (SELECT conv_id * 100000 + turn AS key, conv_id, turn, fup_turn, text, response, followup FROM turned WHERE role = 'user' AND r1 = 'assistant' AND r2 = 'user'),
    asked AS (SELECT DISTINCT key AS query_id, unnest({tokens_sql('text')}) AS term FROM asking), {TFIDF},
    recalled AS (SELECT query_id AS key, id AS node, substring(d.text, 1, 200) AS text FROM (SELECT * FROM tfidf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 3) JOIN documents d ON doc_id = id),
    memory AS (SELECT key, string_agg(text, ' ' ORDER BY node) AS text, sum(length(text)) AS size FROM recalled GROUP BY 1),
    parts AS (SELECT key, 'response' AS kind, 0 AS spot, response AS text FROM asking UNION ALL SELECT key, 'followup', 0, followup FROM asking UNION ALL SELECT key, 'memory', 0, text FROM memory UNION ALL SELECT key, 'node', node, text FROM recalled
        UNION ALL SELECT key, 'resp_on', unnest(range(len(s))), unnest(s) FROM (SELECT key, {LONG_SENTENCES.format('response')} AS s FROM asking) UNION ALL SELECT key, 'fup_on', unnest(range(len(s))), unnest(s) FROM (SELECT key, {LONG_SENTENCES.format('followup')} AS s FROM asking)),
    named AS (SELECT {{'key': key, 'kind': kind, 'spot': spot}} AS id, text FROM parts), {embedded_sql('named', 'made')},
    vectored AS (SELECT id.key AS key, id.kind AS kind, id.spot AS spot, v FROM made),
    largest AS (SELECT a.key, max(list_inner_product(a.v, b.v)) FILTER (WHERE a.kind = 'response') AS resp_sim, max(list_inner_product(a.v, b.v)) FILTER (WHERE a.kind = 'followup') AS fup_sim FROM vectored a JOIN vectored b ON a.key = b.key AND b.kind = 'node' WHERE a.kind IN ('response', 'followup') GROUP BY 1),
    topical AS (SELECT a.key, count(*) FILTER (WHERE a.kind = 'resp_on') AS resp_on, count(*) FILTER (WHERE a.kind = 'fup_on') AS fup_on FROM vectored a JOIN vectored b ON a.key = b.key AND b.kind = 'memory' WHERE a.kind IN ('resp_on', 'fup_on') AND list_inner_product(a.v, b.v) > {embedding.ON_TOPIC}::DOUBLE GROUP BY 1),
    measured AS (SELECT key, conv_id, turn, fup_turn, len(list_filter(regexp_split_to_array(response, '\\s+'), lambda x: x <> '')) AS resp_words, length(response) / greatest(coalesce(size, 0), 1)::DOUBLE AS depth_ratio, coalesce(resp_sim, 0) AS resp_sim, coalesce(fup_sim, 0) AS fup_sim,
        coalesce(resp_on, 0) / greatest(len({LONG_SENTENCES.format('response')}), 1)::DOUBLE AS resp_on_topic, coalesce(fup_on, 0) / greatest(len({LONG_SENTENCES.format('followup')}), 1)::DOUBLE AS fup_on_topic, len({LONG_SENTENCES.format('followup')}) AS fup_sentences
        FROM asking LEFT JOIN largest USING (key) LEFT JOIN topical USING (key) LEFT JOIN memory USING (key))"""


def measured(m: Memory, cut: int | None = None):
    """key, conv_id, fup_turn and the measures of each response between two messages of a user, against what the first message recalls: the three best texts by TF-IDF, whole or up to so many characters."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    lead = lambda c, k: F.lead(c, k).over(order)
    turned = m.turns.select("conv_id", "turn", "text", "role", lead("role", 1).alias("r1"), lead("text", 1).alias("response"), lead("role", 2).alias("r2"), lead("text", 2).alias("followup"), lead("turn", 2).alias("fup_turn"))
    asking = written(turned.filter("role = 'user' and r1 = 'assistant' and r2 = 'user'").withColumn("key", F.col("conv_id") * 100000 + F.col("turn")), "asking")
    own, n, index = written(terms.query_terms(asking.select(F.col("key").alias("query_id"), "text")), "terms"), m.table("documents").count(), m.index
    best = terms.ranked(matches.matches(terms.weighed(own, index, n), terms.postings(index, own.select("term").distinct()), n, 3), 3).select(F.col("query_id").alias("key"), F.col("id").alias("node"))
    if cut is None:
        recalled, counts = best.join(m.bare_nodes.select(F.col("id").alias("node"), F.length("content").alias("size")), "node"), index
    else:
        recalled, counts = best.join(m.bare_nodes.select(F.col("id").alias("node"), F.substring("content", 1, cut).alias("text")), "node"), None
    return embedding.measures(asking.select("key", "response", "followup"), written(recalled, "recalled"), terms.document_frequency(index), n, counts=counts).join(asking.select("key", "conv_id", "turn", "fup_turn"), "key")


WHOLE = MEASURED.replace("substring(d.text, 1, 200) AS text", "d.text")


@query(f"WITH {WHOLE} SELECT conv_id, turn, resp_words, {', '.join(f'{round_sql(x)} AS {x}' for x in ('depth_ratio', 'resp_sim', 'fup_sim', 'resp_on_topic', 'fup_on_topic'))}, fup_sentences FROM measured")
def q_response_measures(m):
    """How deep, how like and how much on topic each response and its follow-up are, against the whole texts that were recalled."""
    return measured(m).select("conv_id", "turn", "resp_words", *map(r6, ("depth_ratio", "resp_sim", "fup_sim", "resp_on_topic", "fup_on_topic")), "fup_sentences")


@query(f"""WITH {MEASURED}, {SIGNALS}, said2 AS (SELECT s.*, m.* EXCLUDE (conv_id, turn), fup_sim - resp_sim AS change, affirm_strong + affirm_moderate + affirm_building + extension > 0 OR opens = 'positive' AS liked, redirect_strong + redirect_mild + complaint > 0 OR opens = 'negative' AS disliked
        FROM said s LEFT JOIN measured m ON s.conv_id = m.conv_id AND s.turn = m.fup_turn),
    sums AS (SELECT conv_id, turn,
        [0.25::DOUBLE * (affirm_strong > 0)::INT, 0.1::DOUBLE * (affirm_moderate > 0)::INT, 0.15::DOUBLE * (affirm_building > 0)::INT, 0.2::DOUBLE * (extension > 0)::INT, 0.12::DOUBLE * (opens = 'positive')::INT,
         0.15::DOUBLE * coalesce(depth_ratio > 0.3, false)::INT, 0.08::DOUBLE * coalesce(resp_sim > 0.65, false)::INT, 0.08::DOUBLE * coalesce(change > 0.05, false)::INT, 0.06::DOUBLE * coalesce(resp_on_topic > 0.6, false)::INT] AS pos,
        [0.3::DOUBLE * (redirect_strong > 0)::INT, 0.12::DOUBLE * (redirect_mild > 0 AND redirect_strong = 0)::INT, 0.25::DOUBLE * (complaint > 0)::INT, 0.12::DOUBLE * (opens = 'negative')::INT,
         0.1::DOUBLE * (opens = 'transition' AND redirect_strong + redirect_mild > 0)::INT, 0.08::DOUBLE * (NOT liked AND NOT disliked)::INT, 0.3::DOUBLE * coalesce(resp_words < 5, false)::INT, 0.25::DOUBLE * coalesce(depth_ratio < 0.05, false)::INT,
         0.08::DOUBLE * coalesce(depth_ratio >= 0.05 AND depth_ratio < 0.15, false)::INT, 0.1::DOUBLE * coalesce(resp_sim < 0.4 AND resp_sim > 0, false)::INT, 0.12::DOUBLE * coalesce(change < -0.2, false)::INT, 0.06::DOUBLE * coalesce(resp_on_topic = 0 AND resp_words > 10, false)::INT,
         0.15::DOUBLE * coalesce(resp_sim > 0.5 AND fup_sim < 0.4 AND change < -0.1, false)::INT, 0.1::DOUBLE * coalesce(fup_sentences > 3 AND fup_on_topic < 0.3, false)::INT] AS neg,
        [0.05::DOUBLE * (opens = 'transition')::INT, 0.25::DOUBLE * (opens = 'transition' AND affirm_building + extension + affirm_strong = 0 AND NOT contains(text, '?'))::INT] AS unc FROM said2),
    t AS (SELECT conv_id, turn, list_sum(pos) AS pos, list_sum(neg) AS neg, list_sum(unc) AS unc, len(list_filter(pos || neg || unc, lambda x: x > 0)) AS n FROM sums),
    e AS (SELECT *, (pos - neg) / (pos + neg + unc + 0.01::DOUBLE) AS evidence, least(1.0::DOUBLE, abs(pos - neg) / (pos + neg + 0.01::DOUBLE) * least(n / 3.0::DOUBLE, 1.0::DOUBLE)) AS confidence FROM t)
    SELECT conv_id, turn, {round_sql('evidence')} AS evidence, {round_sql('confidence')} AS confidence, {round_sql('CASE WHEN confidence >= 0.15::DOUBLE THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (evidence + 1) / 2)) END')} AS precision,
    CASE WHEN confidence < 0.15::DOUBLE THEN 'ask_operator' WHEN evidence > 0.1::DOUBLE THEN 'positive' WHEN evidence < -0.1::DOUBLE THEN 'negative' ELSE 'neutral' END AS label FROM e""")
def q_evidence(m):
    """What each follow-up says of the response before it, by all families of signals and measures."""
    about = measured(m, 200).drop("key", "turn").withColumnRenamed("fup_turn", "turn")
    return feedback.evidence(followups(m).join(about, ["conv_id", "turn"], "left")).select("conv_id", "turn", r6("evidence"), r6("confidence"), r6("precision"), "label")


@query("""WITH x AS (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER w AS a, min(CASE WHEN role = 'user' THEN turn END) OVER w AS u FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    y AS (SELECT *, a IS NOT NULL AND (u IS NULL OR a < u) AS answered FROM x WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN answered THEN a END AS response_turn, CASE WHEN answered THEN u END AS followup_turn, CASE WHEN answered AND u IS NOT NULL THEN 'FEEDBACK' WHEN answered THEN 'RESPONSE' ELSE 'LOGGED' END AS state FROM y""")
def q_recall_state(m):
    return feedback.recall_states(m.turns)
