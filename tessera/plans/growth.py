"""Queries on what a store learns: vocabulary, primes, golden sets, backfills, and scores as SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sql as functions
from tessera.functions import text as T
from tessera.operators import graph, terms, vectors
from tessera.plans.network import NOW, edges
from tessera.plans.registry import query, r6, whole
from tessera.plans.retrieval import ASKED, COUNTS, CONFIDENT, FREQUENCY, RECENCY, age_hours, asked, round_sql
from tessera.plans.upkeep import BRIDGED, first, number
from tessera.sources import transcripts
from tessera.sources.fixtures import asof
from tessera.sources.shared import shared_dir


@query(f"""WITH q AS (SELECT * FROM vectors WHERE id % 50 = 0), a AS (SELECT v.* FROM vectors v JOIN nodes n ON v.id = n.id WHERE evolution = 'aspiration' AND NOT archived),
    met AS (SELECT q.id AS query_id, a.id, list_inner_product(q.embedding, a.embedding) AS s FROM q, a WHERE q.id <> a.id) SELECT query_id, id, {round_sql('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r FROM met) WHERE r <= 2 AND s > 0.1""", "nodes", "vectors")
def q_primed(m):
    """The two aspirations nearest to each query, where near enough."""
    open_ = m.bare_nodes.filter("evolution = 'aspiration' and not archived").join(m.vectors.select("id", "embedding"), "id").select("id", "embedding")
    queries = m.vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.top_k(queries, open_, 2).filter("score > 0.1").select("query_id", "id", r6("score", "similarity"))


@query(f"WITH {COUNTS}, {ASKED} SELECT term, id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY id) AS r FROM counts SEMI JOIN asked USING (term)) WHERE r <= 5")
def q_vocab_targets(m):
    """The first five nodes of each term of the query batch."""
    some = terms.query_terms(asked(m)).select("term").distinct()
    return first(m.index.select("term", "id").join(some, "term", "left_semi"), ["term"], ["id"], 5).select("term", "id")


STRATEGIES = {"camel": r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", "snake": r"\b[a-z]+(?:_[a-z0-9]+)+\b", "acronym": r"\b[A-Z]{3,6}\b", "quoted": r'"[^"\n]{3,40}"', "called": r"\bcalled [A-Za-z]+\b", "key": r"\b[A-Za-z_]+=[A-Za-z0-9]+\b", "mail": r"\b[a-z.]+@[a-z.]+[a-z]\b"}


@query("SELECT DISTINCT strategy, lower(term) AS term FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '{p}')) AS term FROM documents" for k, p in STRATEGIES.items()) + ")")
def q_vocab_candidates(m):
    """Candidates of vocabulary by seven strategies, each with where it came from."""
    plain = F.regexp_replace("content", r"[^\x00-\x7F]", " ")  # as word bounds of other letters differ between engines
    named = lambda k: lambda t: F.struct(F.lit(k).alias("strategy"), F.lower(t).alias("term"))
    found = F.concat(*(F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), named(k)) for k, p in STRATEGIES.items()))
    return m.bare_nodes.select(F.explode(found).alias("x")).select("x.*").distinct()


@query(f"WITH p AS (SELECT n.id, list_inner_product(a.embedding, b.embedding) AS s FROM nodes n JOIN vectors a ON n.id = a.id JOIN vectors b ON b.id = n.id + 1) SELECT id, {round_sql('s')} AS similarity, s < 0 AS pruned FROM p", "nodes", "vectors")
def q_quote_prune(m):
    """Quotes (the next vector stands for one) that have nothing to do with their node."""
    quote = m.vectors.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("quote"))
    both = m.bare_nodes.select("id").join(m.vectors.select("id", "embedding"), "id").join(quote, "id").withColumn("s", vectors.dot(F.col("embedding"), F.col("quote")))
    return both.select("id", r6("s", "similarity"), (F.col("s") < 0).alias("pruned"))


@query(f"""SELECT 'errors' AS topic, count(*) FILTER (WHERE event_type = 'error') > 0.15 * count(*) AS raised FROM events UNION ALL SELECT 'unused', count(*) FILTER (WHERE access_count = 0) > 0.5 * count(*) FROM nodes
    UNION ALL SELECT 'unsure', count(*) FILTER (WHERE confidence < 0.4) > 0.2 * count(*) FROM nodes UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 1) > 0 FROM labels""", "nodes")
def q_self_reflection(m):
    """Topics that the store should reflect on, by thresholds."""
    ask = lambda df, topic, c, share: df.agg((F.count_if(c) > share * number()).alias("raised")).select(F.lit(topic).alias("topic"), "raised")
    out = ask(m.table("events"), "errors", F.col("event_type") == "error", 0.15).unionByName(ask(m.nodes, "unused", F.col("access_count") == 0, 0.5))
    return out.unionByName(ask(m.bare_nodes, "unsure", F.col("confidence") < 0.4, 0.2)).unionByName(ask(m.table("labels"), "toxic", F.col("toxic") == 1, 0.0))


@query("""SELECT n.id, CASE WHEN length(content) < 30 THEN NULL WHEN strpos(content, '. ') > 1 AND strpos(content, '. ') <= 200 THEN substring(content, 1, strpos(content, '. ')) WHEN length(content) > 200 THEN substring(content, 1, 197) || '...' ELSE content END AS summary, v.id IS NULL AS needs_vector
    FROM nodes n LEFT JOIN vectors v ON v.id = n.id WHERE n.id % 3 = 0""", "nodes", "vectors")
def q_backfills(m):
    """What nodes without a summary (every third stands for these) get, and whether they need a vector."""
    known = m.vectors.select("id", F.lit(True).alias("known"))
    return m.bare_nodes.filter("id % 3 = 0").join(known, "id", "left").select("id", T.summary(F.col("content")).alias("summary"), F.col("known").isNull().alias("needs_vector"))


@query("SELECT project, min(created_at) AS created_at, max(created_at) AS updated_at, arg_max(id, (created_at, -id)) AS latest FROM nodes WHERE type = 'project' GROUP BY 1", "nodes")
def q_purposes(m):
    """Purposes upserted by project: the first time stays, the latest text wins."""
    p = m.bare_nodes.filter("type = 'project'")
    return p.groupBy("project").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.max_by("id", F.struct("created_at", -F.col("id"))).alias("latest"))


@query("SELECT event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_last_state(m):
    """The newest row of each kind with its JSON read."""
    newest = m.table("events").groupBy("event_type").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("x"))
    return newest.select("event_type", "x.event_id", F.get_json_object("x.props", "$.k").cast("long").alias("k"))


@query(f"SELECT id, coalesce(due_at, {NOW} + INTERVAL 7 DAY) AS due_at FROM nodes WHERE type = 'task'", "nodes")
def q_reminders(m):
    return m.bare_nodes.filter("type = 'task'").select("id", F.coalesce("due_at", asof() + F.expr("interval 7 days")).alias("due_at"))


@query("SELECT id FROM nodes WHERE locked AND length(content) < 300 ORDER BY md5(id || ':thin'), id LIMIT 1", "nodes")
def q_thin_locked(m):
    """One short locked node at random, the same in every run."""
    return m.bare_nodes.filter("locked and length(content) < 300").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":thin")).cast("binary")), "id").limit(1).select("id")


@query("""WITH top AS (SELECT id FROM nodes WHERE locked AND NOT archived ORDER BY access_count DESC, id LIMIT 25) SELECT top.id AS query_id, top.id AS relevant, 2 AS grade FROM top UNION ALL SELECT top.id, target_id, 1 FROM top JOIN edges ON source_id = top.id WHERE weight >= 0.32""", "nodes", "edges")
def q_golden(m):
    """Relevance of a golden set: the most used locked nodes, and what they are strongly linked with."""
    top = m.nodes.filter("locked and not archived").orderBy(F.desc("access_count"), "id").limit(25).select(F.col("id").alias("query_id"))
    linked = top.join(edges(m).filter("weight >= 0.32D"), F.col("query_id") == F.col("source_id")).select("query_id", F.col("target_id").alias("relevant"), F.lit(1).alias("grade"))
    return top.select("query_id", F.col("query_id").alias("relevant"), F.lit(2).alias("grade")).unionByName(linked)


@query(f"WITH {BRIDGED} SELECT a, b, shared, shared >= 4 AS thought, r AS position FROM (SELECT *, row_number() OVER (ORDER BY shared DESC, a, b) AS r FROM free) WHERE r <= 5", "edges")
def q_bridge_sweep(m):
    """The five best bridges of a sweep; those over four shared neighbours become thoughts."""
    best = graph.bridges(edges(m), k=10**6, min_weight=0.0).filter("a < b").orderBy(F.desc("shared"), "a", "b").limit(5)
    order = Window.orderBy(F.desc("shared"), "a", "b")
    return best.select("a", "b", "shared", (F.col("shared") >= 4).alias("thought"), whole(F.row_number().over(order), "position"))


@query("SELECT n_chars > 500 AS predicted, count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def q_confusion(m):
    """A prediction (long texts are good) against the labels."""
    both = m.table("documents").join(m.table("labels"), "doc_id").filter("quality is not null").withColumn("predicted", F.col("n_chars") > 500)
    counts = both.groupBy("predicted").pivot("quality", [0, 1]).count()
    return counts.select("predicted", F.coalesce("0", F.lit(0).cast("long")).alias("poor"), F.coalesce("1", F.lit(0).cast("long")).alias("good"))


@query(f"SELECT id, {RECENCY} AS recency, {round_sql(FREQUENCY)} AS frequency, {round_sql(CONFIDENT)} AS factor FROM nodes", "nodes")
def q_sql_functions(m):
    """Scores by the temporary SQL functions."""
    functions.register(m.spark)
    n = m.nodes.withColumn("hours", age_hours())
    return n.selectExpr("id", "recency_score(hours) AS recency", "round(frequency_score(access_count) + 1e-9D, 6) AS frequency", "round(confidence_factor(confidence) + 1e-9D, 6) AS factor")


SAID = f"""said AS (SELECT conv_id, conv_id % 16 AS log, role, {NOW} + to_seconds(conv_id * 1000 + turn) AS ts, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN 'This is continued from a previous conversation. ' ELSE '' END || text AS text FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL)"""


@query(f"""WITH {SAID}, marks AS (SELECT log, max(ts) AS mark FROM said WHERE role = 'user' AND contains(lower(text), '{transcripts.CONTINUED}') GROUP BY 1)
    SELECT log, role AS kind, ts, md5(text) AS text_md5 FROM said LEFT JOIN marks USING (log) WHERE mark IS NULL OR ts > mark""")
def q_transcript_tails(m):
    """All conversations, appended to sixteen logs in the shared folder, and what the ends of the logs hold since each one's last compaction."""
    mark = F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), "This is continued from a previous conversation. ").otherwise("")
    ts = asof() + F.make_dt_interval(secs=F.col("conv_id") * 1000 + F.col("turn"))
    lines = m.turns.filter("text is not null").select((F.col("conv_id") % 16).alias("log"), F.col("role").alias("type"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.concat(mark, "text").alias("content")).alias("message"))
    path = f"{shared_dir(m.spark)}/logs-{uuid.uuid4().hex}"
    lines.repartition("log").sortWithinPartitions("log", "timestamp").write.partitionBy("log").json(path)
    got = transcripts.read_tails(m.spark, path)
    return got.select(F.regexp_extract("file", r"log=(\d+)", 1).cast("long").alias("log"), "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), F.md5(F.col("texts")[0].cast("binary")).alias("text_md5"))
