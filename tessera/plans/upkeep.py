"""Queries on the state of the store: scopes, joins, lifecycle steps and tuning decisions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.text import tokens
from tessera.operators import graph, upkeep, vectors
from tessera.plans.analytics import ERRORS, errors
from tessera.plans.network import NOW, ago, edges, pairs
from tessera.plans.registry import query, r6, whole
from tessera.plans.retrieval import HYBRID, hybrid, round_sql, tokens_sql
from tessera.sources.fixtures import Memory, asof

AGE = f"(epoch_us({NOW}) - epoch_us(created_at)) / 8.64e10::DOUBLE"


def number() -> Column:
    return F.count(F.lit(1))


def age_days() -> Column:
    return scoring.hours_between(F.col("created_at"), asof()) / 24


def first(df, key, order, n: int = 1, name: str = "position"):
    """The first n rows of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(name) <= n)


# Scopes and labels.
@query("SELECT id, type FROM nodes WHERE NOT archived AND (project = 'src1' OR project IS NULL OR project = '')", "nodes")
def q_project_scope(m):
    """Nodes of a project and those of none."""
    return upkeep.in_scope(m.bare_nodes.filter("not archived"), "src1").select("id", "type")


@query("SELECT id, row_number() OVER (ORDER BY CASE WHEN project = 'src1' THEN 0 ELSE 1 END, access_count DESC, id) AS position FROM nodes WHERE NOT archived ORDER BY position LIMIT 20", "nodes")
def q_project_priority(m):
    """The project's nodes first, then by use."""
    top = m.nodes.filter("not archived").orderBy(F.when(F.col("project") == "src1", 0).otherwise(1), F.desc("access_count"), "id").limit(20)
    return top.select("id", whole(F.row_number().over(Window.orderBy(F.when(F.col("project") == "src1", 0).otherwise(1), F.desc("access_count"), "id")), "position"))


@query(f"SELECT id FROM nodes WHERE created_at BETWEEN {NOW} - INTERVAL 21 DAY AND {NOW} - INTERVAL 7 DAY", "nodes")
def q_temporal_range(m):
    return m.bare_nodes.filter(F.col("created_at").between(ago(21), ago(7))).select("id")


LABELS = f"""SELECT id, CASE WHEN {AGE} * 24 < 1 THEN 'just_now' WHEN {AGE} < 1 THEN 'today' WHEN {AGE} < 7 THEN 'this_week' WHEN {AGE} < 30 THEN 'this_month' ELSE 'older' END AS freshness,
    CASE WHEN locked OR evolution IS NOT NULL THEN 0.9::DOUBLE WHEN type IN ('mechanism', 'purpose', 'impact', 'vocabulary') THEN 0.8::DOUBLE WHEN type IN ('rule', 'lesson', 'constraint', 'convention') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS priority,
    coalesce(confidence, CASE WHEN locked THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS confidence, locked OR type IN ('rule', 'lesson', 'constraint', 'convention', 'impact') AS action_expected, evolution IS NOT NULL AS feedback_needed FROM nodes"""


@query(LABELS, "nodes")
def q_labels(m):
    """Derived labels of every node."""
    return upkeep.labels(m.bare_nodes, asof())


@query("SELECT id, personal, locked OR personal = 'fixed' AS locked FROM nodes WHERE personal IS NOT NULL AND NOT archived", "nodes")
def q_personal(m):
    """Personal nodes; fixed ones are locked."""
    return m.bare_nodes.filter("personal is not null and not archived").select("id", "personal", (F.col("locked") | (F.col("personal") == "fixed")).alias("locked"))


@query(f"""WITH {HYBRID} SELECT query_id, id, mismatch, CASE WHEN mismatch THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS factor, {round_sql("coalesce(confidence, CASE WHEN locked THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) * CASE WHEN mismatch THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END")} AS confidence
    FROM best JOIN nodes USING (id) WHERE rank <= 20 AND personal = 'contextual'""", "nodes", "vectors", "edges")
def q_context_fit(m):
    """Contextual nodes among the twenty best of each query: where the query has no word of their context, score and confidence are damped."""
    found = hybrid(m, 20).select("query_id", "id", "mismatch").join(m.bare_nodes.filter("personal = 'contextual'").select("id", "confidence", "locked"), "id")
    sure = F.coalesce("confidence", F.when(F.col("locked"), 1.0).otherwise(0.7)) * F.when(F.col("mismatch"), 0.6).otherwise(1.0)
    return found.select("query_id", "id", "mismatch", F.when(F.col("mismatch"), 0.7).otherwise(1.0).alias("factor"), r6(sure, "confidence"))


RISK = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in upkeep.DESTRUCTIVE)


@query(f"""WITH said AS (SELECT doc_id AS id, text, {RISK} AS destructive FROM documents), hot AS (SELECT DISTINCT w FROM (SELECT unnest({tokens_sql('title')}) AS w FROM nodes WHERE critical AND NOT archived)),
    met AS (SELECT DISTINCT id FROM (SELECT id, unnest({tokens_sql('text')}) AS w FROM said WHERE destructive) JOIN hot USING (w))
    SELECT said.id, destructive, CASE WHEN NOT destructive THEN 'none' WHEN met.id IS NOT NULL THEN 'high' ELSE 'low' END AS risk FROM said LEFT JOIN met USING (id)""", "nodes")
def q_safety(m):
    """Texts with destructive commands, and their risk by words shared with critical nodes."""
    hot = m.bare_nodes.filter("critical and not archived").select(F.explode(tokens(F.col("title"))).alias("w")).distinct()
    return upkeep.risk(m.bare_nodes.select("id", F.col("content").alias("text")), hot)


@query("SELECT id, title FROM nodes WHERE type = 'mechanism' AND NOT archived AND regexp_matches(lower(title), '(the|license).*(of|text)')", "nodes")
def q_trigger_match(m):
    """Procedures whose title fits a trigger with a wildcard."""
    return m.bare_nodes.filter("type = 'mechanism' and not archived").filter(upkeep.wildcard(F.lower("title"), ("the*of", "the*text", "license*of", "license*text"))).select("id", "title")


@query("SELECT n.id, w.path FROM nodes n, (VALUES ('license'), ('http'), ('token')) w(path) WHERE NOT archived AND type IN ('mechanism', 'lesson', 'rule') AND contains(lower(content), w.path)", "nodes")
def q_change_impact(m):
    """Engineering nodes that mention a changed thing."""
    paths = F.explode(F.array(*(F.lit(x) for x in ("license", "http", "token")))).alias("path")
    some = m.bare_nodes.filter("not archived and type in ('mechanism', 'lesson', 'rule')").select("id", F.lower("content").alias("low"), paths)
    return some.filter(F.contains("low", "path")).select("id", "path")


@query(f"SELECT id, due_at FROM nodes WHERE NOT archived AND due_at <= {NOW}", "nodes")
def q_due(m):
    return m.bare_nodes.filter("not archived").filter(F.col("due_at") <= asof()).select("id", "due_at")


@query(f"WITH {ERRORS} SELECT event_id, user_id, pattern FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pattern ORDER BY ts, event_id) AS r FROM errors) WHERE r = 1")
def q_first_errors(m):
    """Repeated errors of a user, each pattern once."""
    return first(errors(m), ["user_id", "pattern"], ["ts", "event_id"]).select("event_id", "user_id", "pattern")


# Joins.
@query("SELECT id FROM nodes ANTI JOIN vectors USING (id) WHERE NOT archived", "nodes", "vectors")
def q_backfill_queue(m):
    """Nodes that still need a vector."""
    return m.bare_nodes.filter("not archived").join(m.vectors, "id", "left_anti").select("id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))")
def q_uncharted(m):
    """Items that no document contains: candidates meet on a run of inner words, then the whole text is looked for."""
    return upkeep.not_contained(m.table("benchmark"), "item_id", "text", m.bare_nodes, "content", key="id").select("item_id")


@query(f"""WITH {ERRORS}, fixed AS (SELECT DISTINCT user_id % 50 AS id FROM errors WHERE ts > {NOW} - INTERVAL 14 DAY)
    SELECT n.id, f.id IS NOT NULL AS corrected FROM nodes n LEFT JOIN fixed f USING (id) WHERE type IN ('mechanism', 'concept') AND NOT archived AND (f.id IS NOT NULL OR (validated_at IS NULL AND created_at < {NOW} - INTERVAL 14 DAY))""", "nodes")
def q_model_drift(m):
    """Models that were corrected, or never validated for two weeks."""
    fixed = errors(m).filter(F.col("ts") > ago(14)).select((F.col("user_id") % 50).alias("id")).distinct().withColumn("corrected", F.lit(True))
    some = m.bare_nodes.filter("type in ('mechanism', 'concept') and not archived").join(fixed, "id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))
    return some.filter(F.col("corrected") | (F.col("validated_at").isNull() & (F.col("created_at") < ago(14)))).select("id", "corrected")


@query(f"WITH {ERRORS} SELECT id, type FROM nodes WHERE NOT archived AND access_count > 0 AND NOT EXISTS (SELECT 1 FROM errors WHERE user_id = id) AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = id AND toxic = 1)", "nodes")
def q_uncorrected(m):
    """Used nodes that neither an error nor a toxic label speaks against."""
    used = m.nodes.filter("not archived and access_count > 0")
    bad = m.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return used.join(errors(m).select(F.col("user_id").alias("id")), "id", "left_anti").join(bad, "id", "left_anti").select("id", "type")


@query(f"""WITH live AS (SELECT n.*, v.embedding FROM nodes n JOIN vectors v ON n.id = v.id WHERE NOT archived),
    met AS (SELECT a.id AS recent_id, b.id AS rule_id, list_inner_product(a.embedding, b.embedding) AS s FROM live a, live b WHERE a.created_at > {NOW} - INTERVAL 7 DAY AND NOT a.locked AND b.locked AND b.type IN ('rule', 'decision'))
    SELECT recent_id, rule_id, {round_sql('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY recent_id ORDER BY round(s, 9) DESC, rule_id) AS r FROM met) WHERE r = 1 AND s > 0.2""", "nodes", "vectors")
def q_rule_contradictions(m):
    """The likest locked rule of each recent node, where alike enough."""
    live = m.bare_nodes.filter("not archived").join(m.vectors.select("id", "embedding"), "id")
    recent = live.filter("not locked").filter(F.col("created_at") > ago(7)).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    best = vectors.top_k(recent, live.filter("locked and type in ('rule', 'decision')").select("id", "embedding"), 1)
    return best.filter("score > 0.2").select(F.col("query_id").alias("recent_id"), F.col("id").alias("rule_id"), r6("score", "similarity"))


@query("""SELECT s.id, t.id AS neighbour FROM edges e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id WHERE s.critical AND t.locked AND NOT t.archived""", "nodes", "edges")
def q_locked_neighbours(m):
    """Locked neighbours of critical nodes."""
    of = m.bare_nodes.filter("critical").select("id").join(edges(m), F.col("id") == F.col("source_id")).select("id", "target_id")
    return of.join(m.bare_nodes.filter("locked and not archived").select(F.col("id").alias("neighbour")), F.col("target_id") == F.col("neighbour")).select("id", "neighbour")


@query("SELECT DISTINCT e.target_id AS id FROM edges e JOIN nodes n ON e.source_id = n.id WHERE n.evolution IN ('tension', 'hypothesis', 'aspiration') AND NOT n.archived", "nodes", "edges")
def q_protected(m):
    """Nodes next to an open tension, hypothesis or aspiration decay more slowly."""
    return upkeep.protected(m.bare_nodes, edges(m)).select("id")


@query(f"SELECT source_id, target_id, {round_sql('weight')} AS weight FROM coaccess c WHERE weight > 0.35::DOUBLE AND NOT EXISTS (SELECT 1 FROM coaccess o WHERE o.source_id = c.source_id AND o.target_id = c.target_id AND o.n % 5 = 0)", "coaccess")
def q_coaccess_patterns(m):
    """Strong co-access without another relation (pairs with a fifth meeting stand for these)."""
    p = pairs(m)
    other = p.filter("n % 5 = 0").select("source_id", "target_id")
    return p.filter("weight > 0.35").join(other, ["source_id", "target_id"], "left_anti").select("source_id", "target_id", r6("weight"))


# Lifecycle.
@query(f"""SELECT id, least(1.0::DOUBLE, greatest(0.2::DOUBLE, coalesce(confidence, 0.7::DOUBLE) * 0.7::DOUBLE)) AS corrected, least(1.0::DOUBLE, coalesce(confidence, 0.7::DOUBLE) + 0.05::DOUBLE) AS validated,
    greatest(0.1::DOUBLE, coalesce(confidence, 0.7::DOUBLE) - 0.2::DOUBLE) AS diverged, least(1.0::DOUBLE, coalesce(confidence, 0.7::DOUBLE) + 0.1::DOUBLE) AS impact FROM nodes""", "nodes")
def q_confidence_updates(m):
    return m.bare_nodes.select("id", *(upkeep.confidence_after(F.col("confidence"), e).alias(e) for e in ("corrected", "validated", "diverged", "impact")))


@query(f"SELECT id, coalesce(validated_at, {NOW}) AS validated_at, {round_sql('least(1.0::DOUBLE, coalesce(confidence, 0.7::DOUBLE) + 0.05::DOUBLE)')} AS confidence FROM nodes JOIN labels ON doc_id = id WHERE quality = 1", "nodes")
def q_validate(m):
    """Nodes after a validation by a good label."""
    good = m.table("labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return m.bare_nodes.join(good, "id").select("id", F.coalesce("validated_at", asof()).alias("validated_at"), r6(upkeep.confidence_after(F.col("confidence"), "validated"), "confidence"))


@query("SELECT n.id, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status FROM nodes n LEFT JOIN labels ON doc_id = n.id WHERE critical", "nodes")
def q_approval_queue(m):
    """Critical nodes by whether someone approved them."""
    verdict = m.table("labels").select(F.col("doc_id").alias("id"), "quality")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return m.bare_nodes.filter("critical").join(verdict, "id", "left").select("id", status.alias("status"))


@query(f"""SELECT id, CASE WHEN evolution = 'hypothesis' AND coalesce(confidence, 0.5::DOUBLE) >= 0.8::DOUBLE THEN 'confirmed' WHEN {AGE} > 30 AND access_count = 0 THEN 'dismissed' WHEN evolution = 'tension' AND locked THEN 'resolved' ELSE 'active' END AS status
    FROM nodes WHERE evolution IS NOT NULL""", "nodes")
def q_evolution_states(m):
    return upkeep.evolution_states(m.nodes, age_days()).select("id", "status")


@query(f"SELECT source.id AS source_id, target.id AS target_id, CASE source.evolution WHEN 'tension' THEN 'contradicts' WHEN 'hypothesis' THEN 'caused' ELSE 'resolved_by' END AS relation, CASE source.evolution WHEN 'tension' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS weight FROM edges JOIN nodes source ON source_id = source.id JOIN nodes target ON target_id = target.id WHERE source.evolution IN ('tension', 'hypothesis', 'aspiration') AND target.locked", "nodes", "edges")
def q_evolution_edges(m):
    """Typed edges from open evolutions to the locked nodes beside them."""
    from_ = m.bare_nodes.filter("evolution in ('tension', 'hypothesis', 'aspiration')").select(F.col("id").alias("source_id"), "evolution")
    to = m.bare_nodes.filter("locked").select(F.col("id").alias("target_id"))
    relation = F.when(F.col("evolution") == "tension", "contradicts").when(F.col("evolution") == "hypothesis", "caused").otherwise("resolved_by")
    weight = F.when(F.col("evolution") == "tension", 0.9).otherwise(0.85)
    return edges(m).select("source_id", "target_id").join(from_, "source_id").join(to, "target_id").select("source_id", "target_id", relation.alias("relation"), weight.alias("weight"))


@query(f"""WITH a AS (SELECT node_id AS target_id, user_id, ts, event_id FROM accesses), met AS (SELECT n.event_id, n.target_id AS source_id, o.target_id, row_number() OVER (PARTITION BY n.event_id ORDER BY o.ts DESC, o.event_id DESC) AS r
    FROM a n JOIN a o ON n.user_id = o.user_id AND o.ts < n.ts AND o.ts >= n.ts - INTERVAL 1 HOUR) SELECT event_id, source_id, target_id, 0.2::DOUBLE AS weight FROM met WHERE r <= 3 AND source_id <> target_id""", "accesses")
def q_temporal_coaccess(m):
    """Each access with the last three of the same user within an hour."""
    return upkeep.recent_before(m.accesses, hours=1, k=3).filter("source_id <> target_id").select("event_id", "source_id", "target_id", F.lit(0.2).alias("weight"))


BRIDGED = """best AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) <= 50),
    shared AS (SELECT x.target_id AS a, y.target_id AS b, count(DISTINCT x.source_id) AS shared FROM best x JOIN best y ON x.source_id = y.source_id AND x.target_id < y.target_id GROUP BY 1, 2 HAVING count(DISTINCT x.source_id) >= 2),
    free AS (SELECT s.* FROM shared s ANTI JOIN edges e ON s.a = e.source_id AND s.b = e.target_id)"""


@query(f"WITH {BRIDGED} SELECT a, b, shared, CASE WHEN shared >= 4 THEN 'created' WHEN a % 2 = 0 THEN 'pending' ELSE 'expired' END AS status FROM (SELECT *, row_number() OVER (ORDER BY shared DESC, a, b) AS r FROM free) WHERE r <= 10", "edges")
def q_bridge_proposals(m):
    """The ten best bridges of all, by how many neighbours they share, and what became of them."""
    best = graph.bridges(edges(m), k=10**6, min_weight=0.0).filter("a < b").orderBy(F.desc("shared"), "a", "b").limit(10)
    return best.select("a", "b", "shared", F.when(F.col("shared") >= 4, "created").when(F.col("a") % 2 == 0, "pending").otherwise("expired").alias("status"))


# Tuning: aggregates, then decisions.
@query(f"""WITH x AS (SELECT type, count(*) FILTER (WHERE archived) AS gone, count(*) FILTER (WHERE NOT archived) AS live, count(*) FILTER (WHERE access_count = 0 AND NOT archived AND created_at < {NOW} - INTERVAL 7 DAY) AS unused FROM nodes GROUP BY 1)
    SELECT type, CASE WHEN gone > live AND gone >= 3 THEN 1.5::DOUBLE WHEN unused >= 5 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM x WHERE type NOT IN ('rule', 'decision', 'lesson')""", "nodes")
def q_tune_decay(m):
    """Decay scales by what was archived and what was never used; types that never decay are skipped."""
    unused = F.count_if((F.col("access_count") == 0) & ~F.col("archived") & (F.col("created_at") < ago(7)))
    x = m.nodes.filter("type not in ('rule', 'decision', 'lesson')").groupBy("type").agg(F.count_if("archived").alias("gone"), F.count_if(~F.col("archived")).alias("live"), unused.alias("unused"))
    return x.select("type", F.when((F.col("gone") > F.col("live")) & (F.col("gone") >= 3), 1.5).when(F.col("unused") >= 5, 0.75).otherwise(1.0).alias("factor"))


@query(f"""WITH x AS (SELECT count(*) AS n, count(*) FILTER (WHERE n.created_at < {NOW} - INTERVAL 30 DAY) / greatest(1, count(*)) AS old FROM accesses a JOIN nodes n ON a.node_id = n.id WHERE a.ts > {NOW} - INTERVAL 7 DAY)
    SELECT n, {round_sql('old')} AS old_share, CASE WHEN n <= 20 THEN 0.30::DOUBLE WHEN old > 0.4 THEN 0.25::DOUBLE WHEN old < 0.1 THEN 0.35::DOUBLE ELSE 0.30::DOUBLE END AS recency, CASE WHEN n <= 20 THEN 0.35::DOUBLE WHEN old > 0.4 THEN 0.40::DOUBLE WHEN old < 0.1 THEN 0.30::DOUBLE ELSE 0.35::DOUBLE END AS relevance FROM x""", "nodes")
def q_tune_weights(m):
    """Weights of recency and relevance by the share of old nodes among recent accesses."""
    x = m.accesses.filter(F.col("ts") > ago(7)).join(m.bare_nodes.select(F.col("id").alias("node_id"), "created_at"), "node_id").agg(number().alias("n"), (F.count_if(F.col("created_at") < ago(30)) / F.greatest(F.lit(1), number())).alias("old"))
    step = F.when(F.col("n") <= 20, 0).when(F.col("old") > 0.4, 1).when(F.col("old") < 0.1, -1).otherwise(0)
    return x.select("n", r6("old", "old_share"), F.when(step == 1, 0.25).when(step == -1, 0.35).otherwise(0.30).alias("recency"), F.when(step == 1, 0.40).when(step == -1, 0.30).otherwise(0.35).alias("relevance"))


@query(f"""WITH x AS (SELECT count(*) FILTER (WHERE quality IS NOT NULL) AS judged, count(*) FILTER (WHERE quality = 0) / greatest(1, count(*)) AS dismissed FROM nodes n JOIN labels ON doc_id = n.id WHERE evolution IS NOT NULL)
    SELECT judged, {round_sql('dismissed')} AS dismissed, CASE WHEN judged >= 5 AND dismissed > 0.6 THEN 0.70::DOUBLE WHEN judged >= 10 AND dismissed < 0.2 THEN 0.62::DOUBLE ELSE 0.65::DOUBLE END AS threshold FROM x""", "nodes")
def q_tune_discovery(m):
    """Threshold of discoveries by how many of the judged ones were dismissed."""
    x = m.bare_nodes.filter("evolution is not null").join(m.table("labels").select(F.col("doc_id").alias("id"), "quality"), "id").agg(F.count("quality").alias("judged"), (F.count_if(F.col("quality") == 0) / F.greatest(F.lit(1), number())).alias("dismissed"))
    return x.select("judged", r6("dismissed"), F.when((F.col("judged") >= 5) & (F.col("dismissed") > 0.6), 0.70).when((F.col("judged") >= 10) & (F.col("dismissed") < 0.2), 0.62).otherwise(0.65).alias("threshold"))


@query(f"WITH x AS (SELECT avg(stability) AS s FROM nodes WHERE NOT archived) SELECT {round_sql('s')} AS mean, CASE WHEN s > 5 THEN 1.4::DOUBLE WHEN s < 0.5 THEN 1.7::DOUBLE ELSE 1.5::DOUBLE END AS boost FROM x", "nodes")
def q_tune_stability(m):
    return m.bare_nodes.filter("not archived").agg(F.avg("stability").alias("s")).select(r6("s", "mean"), F.when(F.col("s") > 5, 1.4).when(F.col("s") < 0.5, 1.7).otherwise(1.5).alias("boost"))


@query("SELECT count(*) AS vectors, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS semantic, CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS keyword FROM vectors", "vectors")
def q_tune_blend(m):
    """Weights of the two paths: all to keywords where there are no vectors."""
    return m.vectors.agg(number().alias("vectors")).select("vectors", F.when(F.col("vectors") == 0, 0.0).otherwise(0.9).alias("semantic"), F.when(F.col("vectors") == 0, 1.0).otherwise(0.1).alias("keyword"))


@query(f"""WITH hubs AS (SELECT source_id AS id FROM edges GROUP BY 1 HAVING count(*) > 28), x AS (SELECT count(*) FILTER (WHERE h.id IS NOT NULL) / greatest(1, count(*)) AS share FROM accesses a LEFT JOIN hubs h ON a.node_id = h.id)
    SELECT {round_sql('share')} AS share, CASE WHEN share > 0.5 THEN 35 WHEN share < 0.1 THEN 45 ELSE 40 END AS threshold FROM x""", "edges")
def q_tune_hubs(m):
    """Threshold of hub damping by the hubs' share of accesses."""
    hubs = graph.degrees(edges(m)).filter("degree > 28").select(F.col("id").alias("node_id"), F.lit(True).alias("hub"))
    x = m.accesses.join(hubs, "node_id", "left").agg((F.count("hub") / F.greatest(F.lit(1), number())).alias("share"))
    return x.select(r6("share"), F.when(F.col("share") > 0.5, 35).when(F.col("share") < 0.1, 45).otherwise(40).alias("threshold"))


@query(f"""WITH x AS (SELECT count(*) AS dreams, count(*) FILTER (WHERE access_count >= 2) / greatest(1, count(*)) AS promoted FROM nodes WHERE evolution = 'pattern' AND created_at > {NOW} - INTERVAL 30 DAY)
    SELECT dreams, {round_sql('promoted')} AS promoted, CASE WHEN dreams > 10 AND promoted > 0.1 THEN 4 WHEN dreams > 30 AND promoted = 0 THEN 2 ELSE 3 END AS walks, CASE WHEN dreams > 10 AND promoted > 0.1 THEN 6 ELSE 5 END AS steps FROM x""", "nodes")
def q_tune_dreams(m):
    """Number and length of walks by how many found patterns were used again."""
    x = m.nodes.filter("evolution = 'pattern'").filter(F.col("created_at") > ago(30)).agg(number().alias("dreams"), (F.count_if(F.col("access_count") >= 2) / F.greatest(F.lit(1), number())).alias("promoted"))
    more = (F.col("dreams") > 10) & (F.col("promoted") > 0.1)
    return x.select("dreams", r6("promoted"), F.when(more, 4).when((F.col("dreams") > 30) & (F.col("promoted") == 0), 2).otherwise(3).alias("walks"), F.when(more, 6).otherwise(5).alias("steps"))


@query(f"""WITH x AS (SELECT count(*) FILTER (WHERE n > 3) AS dense, {round_sql('avg(epoch_us(ended) - epoch_us(started)) / 6e7::DOUBLE')} AS minutes FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM events WHERE ts > {NOW} - INTERVAL 7 DAY GROUP BY 1, 2))
    SELECT dense, minutes, CASE WHEN dense > 3 AND minutes < 30 THEN 30 ELSE 40 END AS boot_limit, CASE WHEN dense > 3 AND minutes < 30 THEN 12 ELSE 15 END AS recall_limit FROM x""")
def q_tune_boot(m):
    """Limits of the first context by how dense and short the week's sessions were."""
    daily = m.table("events").filter(F.col("ts") > ago(7)).groupBy("user_id", F.to_date("ts").alias("day")).agg(number().alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    minutes = F.avg(scoring.hours_between(F.col("started"), F.col("ended")) * 60)
    x = daily.agg(F.count_if(F.col("n") > 3).alias("dense"), r6(minutes, "minutes"))
    short = (F.col("dense") > 3) & (F.col("minutes") < 30)
    return x.select("dense", "minutes", F.when(short, 30).otherwise(40).alias("boot_limit"), F.when(short, 12).otherwise(15).alias("recall_limit"))


@query(f"""SELECT id, {round_sql('s')} AS similarity FROM (SELECT n.id, max(list_inner_product(v.embedding, w.embedding)) AS s FROM nodes n JOIN vectors v ON n.id = v.id, nodes k JOIN vectors w ON k.id = w.id WHERE NOT n.locked AND NOT n.archived AND n.access_count >= 5 AND k.locked AND NOT k.archived AND k.id <> n.id GROUP BY 1) WHERE s < 0.6""", "nodes", "vectors")
def q_orphan_beliefs(m):
    """Much used unlocked nodes that no locked node is close to."""
    live = m.nodes.filter("not archived").select("id", "locked", "access_count").join(m.vectors.select("id", "embedding"), "id")
    used = live.filter("not locked and access_count >= 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.top_k(used, live.filter("locked").select("id", "embedding"), 1).filter("score < 0.6").select(F.col("query_id").alias("id"), r6("score", "similarity"))


@query("SELECT id, access_count >= 2 AS promoted FROM nodes WHERE evolution = 'pattern' AND NOT archived", "nodes")
def q_dream_promotion(m):
    return m.nodes.filter("evolution = 'pattern' and not archived").select("id", (F.col("access_count") >= 2).alias("promoted"))


@query(f"""SELECT 'no vector' AS issue, count(*) AS n FROM nodes ANTI JOIN vectors USING (id) UNION ALL SELECT 'no edge', count(*) FROM (SELECT id FROM nodes ANTI JOIN edges ON id = source_id)
    UNION ALL SELECT 'no confidence', count(*) FROM nodes WHERE confidence IS NULL UNION ALL SELECT 'short content', count(*) FROM nodes WHERE length(content) < 30""", "nodes", "vectors", "edges")
def q_health_check(m):
    """Issues of the store, counted."""
    issue = lambda name, df: df.agg(number().alias("n")).select(F.lit(name).alias("issue"), "n")
    n = m.bare_nodes
    found = issue("no vector", n.join(m.vectors, "id", "left_anti")).unionByName(issue("no edge", n.join(edges(m), F.col("id") == F.col("source_id"), "left_anti")))
    return found.unionByName(issue("no confidence", n.filter("confidence is null"))).unionByName(issue("short content", n.filter("length(content) < 30")))


@query("SELECT l.doc_id AS id, count(DISTINCT a.day) AS revisits, CASE WHEN quality = 0 THEN 'dismissed' WHEN quality = 1 THEN 'confirmed' WHEN count(DISTINCT a.day) >= 3 THEN 'promoted' ELSE 'staged' END AS status FROM labels l LEFT JOIN accesses a ON a.node_id = l.doc_id GROUP BY l.doc_id, quality", "accesses")
def q_staged(m):
    """Staged learnings: judged ones, and those promoted by three days of use."""
    visits = m.accesses.groupBy(F.col("node_id").alias("doc_id")).agg(F.count_distinct("day").alias("revisits"))
    s = m.table("labels").join(visits, "doc_id", "left").withColumn("revisits", F.coalesce("revisits", F.lit(0).cast("long")))
    status = F.when(F.col("quality") == 0, "dismissed").when(F.col("quality") == 1, "confirmed").when(F.col("revisits") >= 3, "promoted").otherwise("staged")
    return s.select(F.col("doc_id").alias("id"), "revisits", status.alias("status"))
