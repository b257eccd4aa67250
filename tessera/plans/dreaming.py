"""Queries of dreams: one night for every hundred nodes, two hours apart, the last one now, over the edges known before the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import dreams, graph
from tessera.plans.network import NOW, edges, unit_sql, walks_sql
from tessera.plans.registry import query
from tessera.sources.fixtures import Memory, asof
from tessera.sources.shared import written

NIGHTS = "greatest(1, (SELECT count(*) FROM documents) // 100)"
#: Nights, what was known before them, their pools, starts and walks, and what is between the walks' ends.
DREAMT = f"""nights AS (SELECT {NIGHTS} AS n),
first_day AS (SELECT CAST({NOW} - to_minutes(CAST({K.MATURATION_MINUTES} * (n - 1) AS BIGINT)) AS DATE) AS day FROM nights),
early_some AS (SELECT s.* FROM sessions s, first_day f WHERE s.day < f.day QUALIFY row_number() OVER (PARTITION BY user_id, s.day ORDER BY uses DESC, node_id) <= 15),
early_pairs AS (SELECT a.node_id AS source_id, b.node_id AS target_id, least(1.0::DOUBLE, 0.3::DOUBLE + 0.02::DOUBLE * (count(*) - 1)) AS weight FROM early_some a JOIN early_some b ON a.user_id = b.user_id AND a.day = b.day AND a.node_id < b.node_id GROUP BY 1, 2),
early AS (SELECT source_id, target_id, weight FROM early_pairs UNION ALL SELECT target_id, source_id, weight FROM early_pairs),
live AS (SELECT id, locked, emotion, last_accessed, CAST(floor({unit_sql('night', 'id', 7)} * n) AS BIGINT) AS night, {unit_sql('pool', 'id', 7)} AS u FROM nodes, nights WHERE NOT archived AND (NOT locked OR type IN {K.DREAM_LOCKED_TYPES})),
pool AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY night, locked ORDER BY u, id) <= CASE WHEN locked THEN {K.DREAM_POOL_LOCKED} ELSE {K.DREAM_POOL} END),
weighed AS (SELECT id, night, sqrt(coalesce(degree, 0) + 1) * (1 + 0.5::DOUBLE * emotion) * (1 + 1 / (1 + greatest(0.0::DOUBLE, coalesce((epoch_us({NOW}) - epoch_us(last_accessed)) / 8.64e10::DOUBLE, 30.0::DOUBLE)))) AS w
    FROM pool LEFT JOIN (SELECT source_id AS id, count(*) AS degree FROM early WHERE weight >= 0.1 GROUP BY 1) USING (id)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY ln({unit_sql('seed', 'id', 7)}) / w DESC, id) - 1 AS place FROM weighed QUALIFY place < {2 * K.DREAMS}),
dream_starts AS (SELECT (night * {K.DREAMS} + place // 2) * 2 + place % 2 AS walk_id, night, place // 2 + 1 AS dream, place % 2 AS side, id FROM drawn QUALIFY count(*) OVER (PARTITION BY night, place // 2) = 2),
some_ways AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY {unit_sql('way', 'source_id', 'target_id', 7)}, target_id) <= {K.DREAM_NEIGHBOURS}),
{walks_sql('dream_starts', 'some_ways', K.DREAM_STEPS)},
walked AS (SELECT s.*, path, path[-1] AS far FROM dream_starts s JOIN w{K.DREAM_STEPS} USING (walk_id)),
two AS (SELECT a.night, a.dream, a.id AS seed_a, b.id AS seed_b, a.path AS walk_a, b.path AS walk_b, a.far AS end_a, b.far AS end_b FROM walked a JOIN walked b ON a.night = b.night AND a.dream = b.dream AND a.side = 0 AND b.side = 1),
felt AS (SELECT t.*, EXISTS (SELECT 1 FROM early e WHERE e.source_id = end_a AND e.target_id = end_b) AS joined, epoch_us({NOW}) - epoch_us(greatest(a.last_accessed, b.last_accessed)) AS gap, a.type <> b.type AS kinds, a.project <> b.project AS projects, greatest(a.emotion, b.emotion) AS emotion,
    a.title AS title_a, b.title AS title_b FROM two t JOIN nodes a ON a.id = end_a JOIN nodes b ON b.id = end_b),
scored AS (SELECT *, CASE WHEN gap < 24 * 3.6e9 THEN 3 WHEN gap < 72 * 3.6e9 THEN 2 WHEN gap < 168 * 3.6e9 THEN 1 ELSE 0 END + coalesce(kinds, false)::INT + 2 * coalesce(projects, false)::INT + CASE WHEN emotion > 0.5 THEN 2 WHEN emotion > 0.3 THEN 1 ELSE 0 END + least(2, (len(walk_a) + len(walk_b)) // 4) AS interest FROM felt),
dreamt AS (SELECT *, interest >= 4 AS surfaces, interest >= 6 AND coalesce(max(interest) OVER (PARTITION BY night ORDER BY dream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6 AS thought FROM scored)"""


def nights(m: Memory) -> int:
    return max(1, m.table("documents").count() // 100)


def known_before(m: Memory, n: int):
    """Edges from sessions on days before the first night."""
    first = (asof() - F.make_dt_interval(mins=F.lit(K.MATURATION_MINUTES * (n - 1)))).cast("date")
    return written(graph.undirected(graph.co_access(m.sessions.filter(F.col("day") < first))), "edges")


def dreamt(m: Memory, n: int, early):
    return dreams.dream(written(m.nodes.drop("content"), "dream-nodes"), early, asof(), n)


@query(f"WITH {DREAMT} SELECT night, dream, seed_a, seed_b, array_to_string(walk_a, ',') AS walk_a, array_to_string(walk_b, ',') AS walk_b, end_a, end_b, joined, CAST(interest AS BIGINT) AS interest, surfaces, thought FROM dreamt", "nodes", "sessions")
def q_dreams(m):
    """Two walks from seeds drawn by weight in each dream, and how interesting it is that they end where they do."""
    n = nights(m)
    got = dreamt(m, n, known_before(m, n))
    return got.withColumns({f"walk_{x}": F.concat_ws(",", F.col(f"walk_{x}").cast("array<string>")) for x in "ab"})


@query(f"""WITH {DREAMT}, free AS (SELECT night, dream, end_a AS source_id, end_b AS target_id, {NOW} - to_minutes(CAST({K.MATURATION_MINUTES} * (n - 1 - night) AS BIGINT)) AS told FROM dreamt, nights WHERE end_a <> end_b AND NOT joined),
    once AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY night, dream) = 1),
    made AS (SELECT *, told + to_minutes({K.MATURATION_MINUTES}) AS matures_at FROM once QUALIFY row_number() OVER (PARTITION BY night ORDER BY dream) <= {K.DREAM_PROPOSALS})
    SELECT source_id, target_id, night, matures_at, CASE WHEN matures_at > {NOW} THEN 'pending' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.source_id = made.source_id AND e.target_id = made.target_id) THEN 'expired' ELSE 'created' END AS status FROM made""", "nodes", "edges")
def q_dream_proposals(m):
    """Bridges that dreams propose, and what has become of them."""
    n = nights(m)
    early = known_before(m, n)
    at = asof() - F.make_dt_interval(mins=(K.MATURATION_MINUTES * (n - 1 - F.col("night"))).cast("int"))
    candidates = dreamt(m, n, early).select("night", "dream", F.col("end_a").alias("source_id"), F.col("end_b").alias("target_id"), at.alias("at"))
    return dreams.proposals(candidates, early, edges(m), asof())


@query(f"""WITH {DREAMT} SELECT night, dream, 'Dream: ' || substring(title_a, 1, 40) || ' ↔ ' || substring(title_b, 1, 40) AS title, md5('Association: "' || sa.title || '" → "' || title_a || '" | "' || sb.title || '" → "' || title_b || '"') AS content_md5, end_a, end_b
    FROM dreamt JOIN nodes sa ON sa.id = seed_a JOIN nodes sb ON sb.id = seed_b WHERE NOT joined AND end_a <> end_b""", "nodes", "sessions")
def q_dream_intuitions(m):
    """The nodes that dreams leave between ends that nothing joins."""
    n = nights(m)
    made = dreams.intuitions(dreamt(m, n, known_before(m, n)), m.bare_nodes)
    return made.select("night", "dream", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("targets")[0].alias("end_a"), F.col("targets")[1].alias("end_b"))
