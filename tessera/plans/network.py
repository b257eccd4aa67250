"""Queries on the co-access graph, and on the jobs that keep nodes and edges in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring
from tessera.operators import graph, resolve, upkeep, vectors
from tessera.plans.registry import query, r6, whole
from tessera.plans.retrieval import round_sql
from tessera.sources.fixtures import ASOF, Memory, asof

NOW = f"TIMESTAMP '{ASOF}'"


def ago(days: int):
    return asof() - F.make_dt_interval(days=F.lit(days))


def pairs(m: Memory):
    return graph.co_access(m.sessions)


def edges(m: Memory):
    return graph.undirected(pairs(m))


def seeds(m: Memory):
    return edges(m).filter("source_id % 30 = 0").select(F.col("source_id").alias("query_id"), F.col("source_id").alias("id")).distinct()


def spread_sql(hops: int) -> str:
    parts = ["""WITH roads AS (SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE weight > 0.05::DOUBLE) WHERE r <= 50)""",
             "a0 AS (SELECT DISTINCT source_id AS query_id, source_id AS id, 1.0::DOUBLE AS activation FROM edges WHERE source_id % 30 = 0)"]
    for h in range(hops):
        parts.append(f"""a{h + 1} AS (SELECT query_id, id, sum(activation) AS activation FROM (SELECT * FROM a{h} UNION ALL
            SELECT query_id, target_id, activation * weight * {0.5 ** (h + 1)}::DOUBLE FROM a{h} JOIN roads ON id = source_id WHERE activation > 0.01::DOUBLE) GROUP BY 1, 2)""")
    return ", ".join(parts) + f" SELECT query_id, id, {round_sql('activation')} AS activation FROM a{hops}"


@query(f"SELECT source_id, target_id, n, {round_sql('weight')} AS weight FROM coaccess", "coaccess")
def q_coaccess_edges(m):
    return pairs(m).select("source_id", "target_id", "n", r6("weight"))


@query(f"SELECT source_id AS id, count(*) AS degree, {round_sql('sum(weight)')} AS total_weight FROM edges GROUP BY 1", "edges")
def q_degree(m):
    return graph.degrees(edges(m)).select("id", "degree", r6("total_weight"))


@query("SELECT source_id AS id, count(*) AS degree FROM edges GROUP BY 1 HAVING count(*) > 28", "edges")
def q_hubs(m):
    return graph.degrees(edges(m)).filter("degree > 28").select("id", "degree")


@query(f"SELECT source_id AS id, {round_sql('CASE WHEN count(*) > 28 THEN 28.0::DOUBLE / count(*) ELSE 1.0::DOUBLE END')} AS damping FROM edges GROUP BY 1", "edges")
def q_hub_damped(m):
    return graph.degrees(edges(m)).select("id", r6(scoring.hub_damping(F.col("degree"), 28), "damping"))


@query("SELECT id FROM nodes ANTI JOIN edges ON id = source_id", "nodes", "edges")
def q_orphans(m):
    return graph.orphans(m.bare_nodes, edges(m)).select("id")


@query("SELECT source_id, target_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rank FROM edges) WHERE rank <= 5", "edges")
def q_topk_neighbors(m):
    return graph.strongest(edges(m), 5).select("source_id", "target_id", whole("rank"))


@query("SELECT target_id AS id, count(*) AS in_degree FROM coaccess GROUP BY 1 HAVING count(*) >= 5", "coaccess")
def q_indegree(m):
    return pairs(m).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree")).filter("in_degree >= 5")


@query(spread_sql(1), "edges")
def q_spread_1hop(m):
    return graph.spread(seeds(m), edges(m), 1).select("query_id", "id", r6("activation"))


@query(spread_sql(3), "edges")
def q_spread_3hop(m):
    return graph.spread(seeds(m), edges(m), 3).select("query_id", "id", r6("activation"))


@query("""WITH best AS (SELECT * FROM edges WHERE weight >= 0.1 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) <= 50),
    shared AS (SELECT x.target_id AS a, y.target_id AS b, count(DISTINCT x.source_id) AS shared FROM best x JOIN best y ON x.source_id = y.source_id AND x.target_id <> y.target_id
    GROUP BY 1, 2 HAVING count(DISTINCT x.source_id) >= 2)
    SELECT a, b, shared, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM shared s ANTI JOIN edges e ON s.a = e.source_id AND s.b = e.target_id) WHERE rank <= 5""", "edges")
def q_bridges(m):
    return graph.bridges(edges(m)).select("a", "b", "shared", whole("rank"))


@query()
def q_random_walks(m):
    return graph.random_walks(seeds(m).select("id"), edges(m))


def unit_sql(name: str, *columns) -> str:
    return "((('0x' || substr(md5(concat_ws(':', '" + name + "', " + ", ".join(map(str, columns)) + ")), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


def walks_sql(starts: str, ways: str, steps: int = 5) -> str:
    """w<steps> (walk_id, path): walks from starts (walk_id, id) along ways, step after step."""
    parts = [f"w0 AS (SELECT walk_id, [id] AS path, id AS here FROM {starts})"]
    for s in range(steps):
        key = f"ln({unit_sql('step', 'walk_id', 'target_id', s, 7)}) / weight"
        parts.append(f"""d{s} AS (SELECT walk_id, path, here, target_id AS next FROM w{s} LEFT JOIN {ways} ON here = source_id QUALIFY row_number() OVER (PARTITION BY walk_id ORDER BY {key} DESC, target_id) = 1),
        w{s + 1} AS (SELECT walk_id, CASE WHEN next IS NULL OR list_contains(path, next) THEN path ELSE list_append(path, next) END AS path, CASE WHEN next IS NULL OR list_contains(path, next) THEN here ELSE next END AS here FROM d{s})""")
    return ", ".join(parts)


@query(f"""WITH ways AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) <= 10), starts AS (SELECT DISTINCT source_id AS walk_id, source_id AS id FROM edges WHERE source_id % 30 = 0),
    {walks_sql('starts', 'ways')} SELECT walk_id, array_to_string(path, ',') AS path FROM w5""", "edges")
def q_walk_paths(m):
    """The walks of q_random_walks, as text."""
    walks = graph.random_walks(seeds(m).select("id"), edges(m))
    return walks.select("walk_id", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query("SELECT source_id, target_id, CASE WHEN n >= 2 THEN least(1.0::DOUBLE, weight + 0.1::DOUBLE) ELSE 0.5::DOUBLE END AS weight, n < 2 AS is_new FROM coaccess", "coaccess")
def q_edge_upsert(m):
    """Edges known from repeated use, after every pair was connected once more."""
    p = pairs(m)
    return graph.upsert_edges(p.filter("n >= 2"), p)


@query(f"SELECT source_id, target_id, {round_sql('CASE WHEN weight > 0.42::DOUBLE THEN 0.4::DOUBLE ELSE weight END')} AS weight FROM coaccess", "coaccess")
def q_weight_cap(m):
    """Edges over a limit fall back under it (limits as the fixture's weights need)."""
    return pairs(m).select("source_id", "target_id", r6(F.when(F.col("weight") > 0.42, 0.4).otherwise(F.col("weight")), "weight"))


@query("SELECT id, type, access_count FROM nodes WHERE NOT locked AND NOT archived AND access_count >= 10", "nodes")
def q_auto_lock(m):
    return m.nodes.filter("not locked and not archived and access_count >= 10").select("id", "type", "access_count")


@query(f"""SELECT n.id, least(10.0::DOUBLE, stability * 1.5::DOUBLE) AS stability FROM nodes n JOIN (SELECT node_id, count(*) AS c FROM accesses WHERE ts > {NOW} - INTERVAL 2 DAY GROUP BY 1 HAVING count(*) >= 3) a ON n.id = a.node_id""", "nodes")
def q_consolidate_stability(m):
    """Nodes used three times or more in the last two days gain stability."""
    used = m.accesses.filter(F.col("ts") > ago(2)).groupBy("node_id").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    return m.bare_nodes.join(used, F.col("id") == F.col("node_id")).select("id", F.least(F.lit(10.0), F.col("stability") * 1.5).alias("stability"))


DAYS = f"(epoch_us({NOW}) - epoch_us(created_at)) / 8.64e10::DOUBLE"
CLAIMS = " + ".join(f"contains(lower(content), '{w}')::INT" for w in K.EXTERNAL_CLAIMS)


@query(f"""WITH a AS (SELECT *, CASE WHEN NOT locked AND emotion > 0.6 AND {DAYS} > 3 THEN greatest(0.7::DOUBLE * 0.7::DOUBLE, confidence * (1 - (0.05::DOUBLE + 0.1::DOUBLE * (emotion - 0.6::DOUBLE) / 0.4::DOUBLE))) ELSE confidence END AS cooled FROM nodes WHERE NOT archived AND confidence IS NOT NULL),
    b AS (SELECT *, CASE WHEN NOT locked AND cooled > 0.2 AND {DAYS} > 7 AND {CLAIMS} >= 2 THEN least(cooled, greatest(0.21::DOUBLE, 0.7::DOUBLE * power(0.5::DOUBLE, {DAYS} / 30))) ELSE cooled END AS decayed FROM a)
    SELECT id, {round_sql("CASE WHEN access_count >= 5 AND decayed < 0.95 AND coalesce(evolution <> 'tension', true) THEN greatest(decayed, least(0.85::DOUBLE, decayed + 0.03::DOUBLE)) ELSE decayed END")} AS confidence FROM b""", "nodes")
def q_recalibrate(m):
    """Confidence after three passes in order: feelings cool, claims about the outside decay, silent use validates."""
    return upkeep.recalibrated(m.nodes.filter("not archived and confidence is not null"), scoring.hours_between(F.col("created_at"), asof()) / 24).select("id", r6("confidence"))


@query(f"SELECT id, {round_sql('least(1.0::DOUBLE, greatest(0.1::DOUBLE, coalesce(confidence, 0.5::DOUBLE) + (CAST(id % 5 AS DOUBLE) / 4 - coalesce(confidence, 0.5::DOUBLE)) * 0.05::DOUBLE))')} AS confidence FROM nodes", "nodes")
def q_confidence_nudge(m):
    return m.bare_nodes.select("id", r6(scoring.nudge(F.col("confidence"), (F.col("id") % 5).cast("double") / 4), "confidence"))


@query("SELECT count(*) FILTER (WHERE n.id IS NULL) AS orphaned, count(*) FILTER (WHERE n.id IS NOT NULL) AS kept FROM vectors v LEFT JOIN nodes n ON v.id = n.id", "vectors", "nodes")
def q_orphan_cleanup(m):
    """Vectors whose node is gone, and those that stay."""
    known = m.bare_nodes.select("id", F.lit(True).alias("known"))
    return m.vectors.select("id").join(known, "id", "left").agg(F.count_if(F.col("known").isNull()).alias("orphaned"), F.count_if(F.col("known").isNotNull()).alias("kept"))


@query(f"""SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'telemetry' END AS log, count(*) AS total,
    count(*) FILTER (WHERE event_type <> 'error' AND ts < {NOW} - INTERVAL 14 DAY) AS pruned FROM events GROUP BY 1""")
def q_retention_prune(m):
    """Telemetry ends after its days; errors stay."""
    log = F.when(F.col("event_type") == "error", "error").otherwise("telemetry")
    old = (F.col("event_type") != "error") & (F.col("ts") < ago(14))
    return m.table("events").groupBy(log.alias("log")).agg(F.count(F.lit(1)).alias("total"), F.count_if(old).alias("pruned"))


def fold_sql(turns: str, likes: str) -> str:
    """alive (k) of a fold: turns (id, k from 1) in order, a turn giving way to any live one that likes (later, earlier) names."""
    return f"""before AS (SELECT later AS k, list(earlier) AS before FROM {likes} GROUP BY 1),
    fold AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS alive UNION ALL SELECT fold.k + 1, CASE WHEN list_has_any(alive, coalesce(before, []::BIGINT[])) THEN alive ELSE list_append(alive, fold.k + 1) END
        FROM fold LEFT JOIN before ON before.k = fold.k + 1 WHERE fold.k < (SELECT count(*) FROM {turns})),
    alive AS (SELECT unnest(alive) AS k FROM fold WHERE k = (SELECT count(*) FROM {turns}))"""


TITLE_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(title), '[\\s\\x0B]+'), lambda w: w <> ''))"
ABSORB = f"""WITH RECURSIVE store AS (SELECT title, max(id) AS dest, min(id) AS place FROM nodes WHERE id % 2 = 0 AND title IS NOT NULL GROUP BY 1),
    items AS (SELECT id, title, locked, row_number() OVER (ORDER BY NOT locked, access_count DESC, id) AS turn FROM nodes WHERE id % 2 = 1 AND title IS NOT NULL),
    store_words AS (SELECT place, dest, unnest({TITLE_WORDS}) AS w FROM store), item_words AS (SELECT id, turn, unnest({TITLE_WORDS}) AS w FROM items),
    near AS (SELECT id, place, any_value(dest) AS dest, count(*) AS overlap FROM item_words JOIN store_words USING (w) GROUP BY 1, 2 HAVING count(*) >= 3),
    best AS (SELECT id, arg_min(dest, (-overlap, place)) AS dest, max(overlap) AS overlap FROM near GROUP BY 1),
    free AS (SELECT id, title, row_number() OVER (ORDER BY turn) AS k FROM items WHERE locked AND id NOT IN (SELECT id FROM best) AND title NOT IN (SELECT title FROM store)),
    shared AS (SELECT x.id AS a, y.id AS b, count(*) AS overlap FROM item_words x JOIN item_words y ON x.w = y.w AND y.turn < x.turn GROUP BY 1, 2 HAVING count(*) >= 3),
    likes AS (SELECT l.k AS later, e.k AS earlier FROM shared JOIN free l ON a = l.id JOIN free e ON b = e.id UNION SELECT l.k, e.k FROM free l JOIN free e ON l.title = e.title AND e.k < l.k),
    {fold_sql("free", "likes")},
    made AS (SELECT free.id, free.title, turn FROM free JOIN alive USING (k) JOIN items USING (id)),
    same AS (SELECT items.id, coalesce(min(dest), min(made.id)) AS same FROM items LEFT JOIN store ON items.title = store.title LEFT JOIN made ON items.title = made.title AND made.turn < items.turn GROUP BY 1),
    newer AS (SELECT a AS id, arg_min(made.id, (-overlap, turn)) AS dest, max(overlap) AS overlap FROM shared JOIN made ON b = made.id GROUP BY 1),
    judged AS (SELECT items.id, same, best.dest AS d1, best.overlap AS o1, newer.dest AS d2, newer.overlap AS o2, made.id IS NOT NULL AS is_new FROM items JOIN same USING (id) LEFT JOIN best USING (id) LEFT JOIN newer USING (id) LEFT JOIN made USING (id)),
    classes AS (SELECT id, CASE WHEN is_new THEN 'absorbed' WHEN same IS NOT NULL THEN 'exact' WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN 'fuzzy' ELSE 'policy' END AS class,
        CASE WHEN is_new THEN NULL WHEN same IS NOT NULL THEN same WHEN d1 IS NULL OR o2 > o1 THEN d2 ELSE d1 END AS matched, CASE WHEN NOT is_new AND same IS NULL THEN CASE WHEN d1 IS NULL OR o2 > o1 THEN o2 ELSE o1 END END AS overlap FROM judged)"""


def absorbed(m: Memory):
    """The odd nodes as another store on its way into that of the even ones, locked and well used nodes first."""
    n = m.nodes.select("id", "title", "locked", "access_count")
    return resolve.absorbed(n.filter("id % 2 = 0"), n.filter("id % 2 = 1"), ~F.col("locked"), -F.col("access_count"))


@query(f"{ABSORB} SELECT id, class, matched, overlap FROM classes", "nodes")
def q_absorb_classes(m):
    """What becomes of each node of another store: known, like a known one, absorbed and known from then on, or left by policy."""
    return absorbed(m)


@query(f"""{ABSORB}, placed AS (SELECT id AS old, coalesce(matched, id) AS new FROM classes WHERE class <> 'policy'),
    moved AS (SELECT s.new AS source_id, t.new AS target_id, max(weight) AS w FROM edges JOIN placed s ON source_id = s.old JOIN placed t ON target_id = t.old GROUP BY 1, 2)
    SELECT source_id, target_id, {round_sql('w')} AS weight FROM moved ANTI JOIN (SELECT * FROM edges WHERE source_id % 2 = 0 AND target_id % 2 = 0) e USING (source_id, target_id) WHERE source_id <> target_id""", "nodes", "edges")
def q_absorb_edges(m):
    """Edges that come with the nodes of the other store, at the places that these were given."""
    e = edges(m)
    return resolve.absorbed_edges(e, absorbed(m), e.filter("source_id % 2 = 0 and target_id % 2 = 0")).select("source_id", "target_id", r6("weight"))


MINED_SQL = "mined AS (SELECT n.id, project, created_at, v.embedding FROM nodes n JOIN vectors v ON n.id = v.id WHERE locked AND NOT archived)"
PAIRS_SQL = f"{MINED_SQL}, mates AS (SELECT a.id AS a_id, b.id AS b_id, a.project AS a_project, b.project AS b_project, a.created_at AS a_created_at, b.created_at AS b_created_at, list_inner_product(a.embedding, b.embedding) AS similarity FROM mined a JOIN mined b ON a.id < b.id)"


def mined(m: Memory):
    """All locked nodes with vectors."""
    live = m.bare_nodes.filter("locked and not archived").select("id", "project", "created_at")
    return live.join(m.vectors.select("id", "embedding"), "id")


@query(f"WITH {PAIRS_SQL} SELECT a_id, b_id, {round_sql('similarity')} AS similarity FROM mates WHERE similarity > 0.3", "nodes", "vectors")
def q_similar_pairs(m):
    return vectors.similar_pairs(mined(m), 0.3).select("a_id", "b_id", r6("similarity"))


@query(f"""WITH {PAIRS_SQL} SELECT a_id, b_id, {round_sql('similarity')} AS similarity FROM mates s ANTI JOIN coaccess e ON s.a_id = e.source_id AND s.b_id = e.target_id
    WHERE similarity > 0.3 ORDER BY round(similarity, 9) DESC, a_id, b_id LIMIT 2""", "nodes", "vectors", "coaccess")
def q_contradictions(m):
    """The two likest pairs that no edge joins yet."""
    free = vectors.similar_pairs(mined(m), 0.3).join(pairs(m), (F.col("a_id") == F.col("source_id")) & (F.col("b_id") == F.col("target_id")), "left_anti")
    return free.orderBy(F.desc(F.round("similarity", 9)), "a_id", "b_id").limit(2).select("a_id", "b_id", r6("similarity"))


@query(f"WITH {PAIRS_SQL} SELECT a_id, b_id, {round_sql('similarity')} AS similarity FROM mates WHERE similarity > 0.1 AND a_project = b_project AND abs(epoch_us(a_created_at) - epoch_us(b_created_at)) >= 7 * 86400000000", "nodes", "vectors")
def q_temporal_contradictions(m):
    """Like nodes of one project, made a week or more apart."""
    n = mined(m)
    made = lambda x: n.select(F.col("id").alias(f"{x}_id"), F.col("created_at").alias(f"{x}_made"))
    both = vectors.similar_pairs(n, 0.1, "project").join(made("a"), "a_id").join(made("b"), "b_id")
    return both.filter(F.abs(scoring.hours_between(F.col("a_made"), F.col("b_made"))) >= 168).select("a_id", "b_id", r6("similarity"))


MERGE = f"""WITH RECURSIVE {PAIRS_SQL}, turns AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM mined),
    likes AS (SELECT greatest(x.k, y.k) AS later, least(x.k, y.k) AS earlier FROM mates JOIN turns x ON a_id = x.id JOIN turns y ON b_id = y.id WHERE similarity > 0.3),
    {fold_sql("turns", "likes")},
    ids AS (SELECT t.id AS dropped, arg_min(s.id, s.k) AS kept FROM likes JOIN turns t ON later = t.k JOIN turns s ON earlier = s.k WHERE later NOT IN (SELECT k FROM alive) AND earlier IN (SELECT k FROM alive) GROUP BY 1)"""


def age():
    return F.timestamp_diff("MICROSECOND", F.col("created_at"), asof())


def merges(m: Memory):
    return resolve.merged(mined(m), 0.3, age())


@query(f"{MERGE} SELECT dropped, kept FROM ids", "nodes", "vectors")
def q_near_dup_merge(m):
    """Nodes that give way to the newest surviving one that they are like (threshold as the fixture's vectors need)."""
    return merges(m)


@query(f"""{MERGE}, groups AS (SELECT coalesce(kept, id) AS kept, n.*, k FROM mined JOIN nodes n USING (id) JOIN turns USING (id) LEFT JOIN ids ON id = dropped)
    SELECT kept AS id, count(*) AS members, sum(access_count)::BIGINT AS access_count, max(validated_at) AS validated_at, arg_min(personal, (id <> kept, k)) FILTER (WHERE personal IS NOT NULL) AS personal, arg_min(due_at, (id <> kept, k)) FILTER (WHERE due_at IS NOT NULL) AS due_at
    FROM groups GROUP BY 1""", "nodes", "vectors")
def q_merge_nodes(m):
    """Survivors with what they take over: accesses together, the latest validation, and where they have none their members' first personal mark and due date."""
    own = m.nodes.join(mined(m).select("id"), "id", "left_semi").withColumn("age", age())
    return resolve.merged_nodes(own, merges(m), ["access_count"], ["validated_at"], {"personal": F.col("age"), "due_at": F.col("age")})


@query(f"""{MERGE}, moved AS (SELECT coalesce(s.kept, source_id) AS source_id, coalesce(t.kept, target_id) AS target_id, weight, s.kept IS NULL AND t.kept IS NULL AS was FROM edges LEFT JOIN ids s ON source_id = s.dropped LEFT JOIN ids t ON target_id = t.dropped)
    SELECT source_id, target_id, {round_sql("arg_max(weight, (was, weight))")} AS weight, NOT max(was) AS moved FROM moved WHERE source_id <> target_id GROUP BY 1, 2""", "nodes", "vectors", "edges")
def q_merge_rewire(m):
    """All edges after the merge, none of which ends on a merged node."""
    return resolve.merged_edges(edges(m), merges(m)).select("source_id", "target_id", r6("weight"), "moved")


#: Calibration looks at the pairs of a sample of so many nodes.
SAMPLED = 100


@query(f"WITH {PAIRS_SQL}, drawn AS (SELECT id FROM mined ORDER BY md5(id || ':c'), id LIMIT {SAMPLED}), drawn_pairs AS (SELECT similarity FROM mates WHERE a_id IN (SELECT id FROM drawn) AND b_id IN (SELECT id FROM drawn)) SELECT {round_sql('quantile_disc(similarity, 0.1)')} AS p10, {round_sql('quantile_disc(similarity, 0.5)')} AS p50, {round_sql('quantile_disc(similarity, 0.9)')} AS p90, {round_sql('avg(similarity)')} AS mean FROM drawn_pairs", "nodes", "vectors")
def q_calibration(m):
    """Percentiles of the similarities in a seeded sample: a sampling operator."""
    drawn = mined(m).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":c")).cast("binary")), "id").limit(SAMPLED)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY similarity)")
    return vectors.similar_pairs(drawn, -2.0).agg(r6(at(0.1), "p10"), r6(at(0.5), "p50"), r6(at(0.9), "p90"), r6(F.avg("similarity"), "mean"))


@query(f"SELECT label, pos, {round_sql('avg(x)')} AS mean, count(*) AS size FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM vectors) GROUP BY 1, 2", "vectors")
def q_centroids(m):
    return vectors.centroids(m.vectors, "label").select("label", "pos", r6("mean"), "size")


@query(f"""WITH RECURSIVE {PAIRS_SQL}, turns AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM mined),
    likes AS (SELECT y.k AS later, x.k AS earlier FROM mates JOIN turns x ON a_id = x.id JOIN turns y ON b_id = y.id WHERE similarity > 0.1 AND a_project = b_project), {fold_sql("turns", "likes")},
    taken AS (SELECT later AS k, min(earlier) AS cluster FROM likes WHERE later NOT IN (SELECT k FROM alive) AND earlier IN (SELECT k FROM alive) GROUP BY 1),
    placed AS (SELECT project AS "group", c.id AS cluster, m.id FROM mined m JOIN turns t USING (id) LEFT JOIN taken USING (k) JOIN turns c ON c.k = coalesce(taken.cluster, t.k))
    SELECT * FROM placed WHERE cluster IN (SELECT cluster FROM placed GROUP BY 1 HAVING count(*) >= 2)""", "nodes", "vectors")
def q_greedy_clusters(m):
    """Clusters of each project's locked nodes (threshold as the fixture's vectors need)."""
    return resolve.greedy_clusters(mined(m).withColumnRenamed("project", "group"), 0.1, 2)


@query(f"""SELECT n.id, {round_sql('sum(weight)')} AS total_weight, count(*) AS edges, CASE WHEN locked THEN stability ELSE greatest(stability, 3.0::DOUBLE) END AS stability FROM edges JOIN nodes n ON source_id = n.id WHERE weight > 0.3::DOUBLE GROUP BY n.id, locked, stability HAVING count(*) >= 5""", "nodes", "edges")
def q_well_connected(m):
    """Nodes with five or more edges over 0.3, and the stability that these give them."""
    of = graph.degrees(edges(m).filter(F.col("weight") > 0.3)).filter("degree >= 5")
    stable = F.when(F.col("locked"), F.col("stability")).otherwise(F.greatest("stability", F.lit(3.0)))
    return of.join(m.bare_nodes.select("id", "locked", "stability"), "id").select("id", r6("total_weight"), F.col("degree").alias("edges"), stable.alias("stability"))


@query()
def q_segments(m):
    """Topic segments of users' accesses by the vectors of the nodes used."""
    used = m.accesses.join(m.vectors, F.col("node_id") == F.col("id"))
    return vectors.segments(used.select(F.concat_ws("/", "user_id", "day").alias("session"), F.col("event_id").alias("position"), "embedding"))
