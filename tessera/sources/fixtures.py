"""The memory model over the fixture tables: nodes, accesses, edges, vectors, turns; all derived, nothing stored."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import written

#: The clock of all checked queries.
ASOF = "2024-02-01 00:00:00"
PERSONAL = ("fixed", "fluid", "contextual", *[None] * 10)
EVOLUTIONS = (*[None] * 4, "tension", "hypothesis", "aspiration", "pattern", "catalyst", *[None] * 10)
TYPES = ("rule", "decision", "concept", "task", "context", "lesson", "mechanism", "project")


def asof():
    return F.expr(f"timestamp_ntz'{ASOF}'")


class Memory:
    """Lazily read tables of one folder, and the model derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def accesses(self) -> DataFrame:
        """node_id, user_id, day, ts of every access: events, mapped to all documents by a hash with a heavy tail (low ids are used most)."""
        k = F.get_json_object("props", "$.k").cast("long")
        events = self.table("events").select("event_id", "user_id", "event_type", "ts", k.alias("k"))
        u = F.conv(F.substring(F.md5(F.concat_ws(":", "event_id", "user_id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        node = F.floor(F.lit(self.table("documents").count()) * u * u * u)
        return events.select("event_id", node.alias("node_id"), "user_id", F.to_date("ts").alias("day"), "ts", "k")

    @cached_property
    def usage(self) -> DataFrame:
        return self.accesses.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))

    @cached_property
    def bare_nodes(self) -> DataFrame:
        """Nodes without their usage."""
        d = F.col("doc_id")
        return self.table("documents").select(
            d.alias("id"),
            F.element_at(F.array(*(F.lit(t) for t in TYPES)), (d % 8 + 1).cast("int")).alias("type"),
            F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.col("source").alias("project"),
            (d % 5 == 0).alias("locked"), (d % 17 == 3).alias("archived"), (d % 97 == 0).alias("critical"),
            ((d % 11).cast("double") / 10).alias("emotion"),
            F.when(d % 7 == 0, F.lit(None).cast("double")).otherwise(0.1 + (d % 10).cast("double") / 10).alias("confidence"),
            (1 + d % 4).cast("double").alias("stability"),
            (asof() - F.make_dt_interval(hours=(d % 1440).cast("int"))).alias("created_at"),
            F.element_at(F.array(*(F.lit(x) for x in PERSONAL)), (d % 13 + 1).cast("int")).alias("personal"),
            F.element_at(F.array(*(F.lit(x) for x in EVOLUTIONS)), (d % 19 + 1).cast("int")).alias("evolution"),
            F.when(d % 8 == 3, asof() - F.make_dt_interval(hours=(d % 1440).cast("int")) + F.make_dt_interval(days=(d % 40).cast("int"))).alias("due_at"),
            F.when(d % 6 == 1, asof() - F.make_dt_interval(hours=(d % 700).cast("int"))).alias("validated_at"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return self.bare_nodes.join(self.usage, "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0).cast("long")))

    @cached_property
    def sessions(self) -> DataFrame:
        """Nodes of each session (a user's day), and how often they were used in it."""
        return self.accesses.groupBy("user_id", "day", "node_id").agg(F.count(F.lit(1)).alias("uses"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @property
    def unwritten_index(self) -> DataFrame:
        """The index for those who read it once."""
        from tessera.operators import terms

        return terms.indexed(self.bare_nodes, F.col("content"))

    @cached_property
    def index(self) -> DataFrame:
        """id, term, c, tf of the contents, as a table of this model: texts are tokenised once, whatever reads it."""
        return written(self.unwritten_index, "index")

    @cached_property
    def entries(self) -> DataFrame:
        """node_id, term, maps_to: words of some titles, and pairs of them, with what they stand for."""
        from tessera.functions.text import tokens

        w = self.bare_nodes.filter("id % 5 = 2").select(F.col("id").alias("node_id"), tokens(F.col("title")).alias("w")).filter(F.size("w") >= 5)
        at = lambda i: F.try_element_at("w", F.lit(i))
        return w.select("node_id", F.explode(F.array(at(1), at(2), at(3), F.concat_ws(" ", at(1), at(2)))).alias("term"), F.slice("w", 4, 2).alias("maps_to"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")


#: The same model as SQL common table expressions.
CTE = {
    "accesses": """accesses AS (SELECT event_id, CAST(floor(n_docs * u * u * u) AS BIGINT) AS node_id, user_id, CAST(ts AS DATE) AS day, ts, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(('0x' || substr(md5(event_id || ':' || user_id), 1, 8))::BIGINT AS DOUBLE) / 4294967296 AS u FROM events), (SELECT count(*) AS n_docs FROM documents))""",
    "usage": "usage AS (SELECT node_id AS id, count(*) AS access_count, max(ts) AS last_accessed FROM accesses GROUP BY 1)",
    "nodes": """nodes AS (SELECT doc_id AS id, (['rule','decision','concept','task','context','lesson','mechanism','project'])[doc_id % 8 + 1] AS type,
        substring(text, 1, 60) AS title, text AS content, source AS project, doc_id % 5 = 0 AS locked, doc_id % 17 = 3 AS archived, doc_id % 97 = 0 AS critical,
        CAST(doc_id % 11 AS DOUBLE) / 10 AS emotion, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0.1::DOUBLE + CAST(doc_id % 10 AS DOUBLE) / 10 END AS confidence,
        CAST(1 + doc_id % 4 AS DOUBLE) AS stability, TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 1440 AS INTEGER)) AS created_at,
        CASE doc_id % 13 WHEN 0 THEN 'fixed' WHEN 1 THEN 'fluid' WHEN 2 THEN 'contextual' END AS personal,
        CASE doc_id % 19 WHEN 4 THEN 'tension' WHEN 5 THEN 'hypothesis' WHEN 6 THEN 'aspiration' WHEN 7 THEN 'pattern' WHEN 8 THEN 'catalyst' END AS evolution,
        CASE WHEN doc_id % 8 = 3 THEN TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 1440 AS INTEGER)) + to_days(CAST(doc_id % 40 AS INTEGER)) END AS due_at,
        CASE WHEN doc_id % 6 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 700 AS INTEGER)) END AS validated_at,
        coalesce(access_count, 0) AS access_count, last_accessed
        FROM documents LEFT JOIN usage ON usage.id = doc_id)""",
    "sessions": "sessions AS (SELECT user_id, day, node_id, count(*) AS uses FROM accesses GROUP BY ALL)",
    "coaccess": """some_of AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY uses DESC, node_id) <= 15),
        coaccess AS (SELECT a.node_id AS source_id, b.node_id AS target_id, count(*) AS n, least(1.0::DOUBLE, 0.3::DOUBLE + 0.02::DOUBLE * (count(*) - 1)) AS weight
        FROM some_of a JOIN some_of b ON a.user_id = b.user_id AND a.day = b.day AND a.node_id < b.node_id GROUP BY 1, 2)""",
    "whole_coaccess": """coaccess AS (SELECT a.node_id AS source_id, b.node_id AS target_id, count(*) AS n, least(1.0::DOUBLE, 0.3::DOUBLE + 0.02::DOUBLE * (count(*) - 1)) AS weight
        FROM sessions a JOIN sessions b ON a.user_id = b.user_id AND a.day = b.day AND a.node_id < b.node_id GROUP BY 1, 2)""",
    "edges": "edges AS (SELECT source_id, target_id, weight FROM coaccess UNION ALL SELECT target_id, source_id, weight FROM coaccess)",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)",
}
CTE["whole_edges"] = CTE["edges"]  # over all pairs of a session's nodes
NEEDS = {"usage": ["accesses"], "nodes": ["usage"], "sessions": ["accesses"], "coaccess": ["sessions"], "edges": ["coaccess"], "whole_coaccess": ["sessions"], "whole_edges": ["whole_coaccess"]}


def with_model(sql: str, *names: str) -> str:
    """sql with the named model tables, and what they need, as common table expressions before its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    body = sql.strip()
    ctes = ",\n".join(CTE[n] for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}"
