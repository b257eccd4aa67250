"""The training-data operators as queries over the tables of one folder, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tessera.llm import ann, annulus, audit, bpe, langid, lm, packing, pieces, quality, secrets, sharding, simhash, url_filter
from tessera.llm.common import ship_code, table


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.within(2), shingle=3).select("doc_id", "fingerprint", "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = langid.identify(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=("digests",))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8).drop("row_number", "position")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("rate", 6).alias("rate"), F.round("upper", 6).alias("upper"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("digests",))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_ann, op3_langid, op4_bpe, op5_quality, op6_lm, op7_packing, op8_secrets, op9_sharding, op10_url_filter, op11_filter_audit, op12_clustering, op13_sentencepiece)
}


def _strength_sql(groups: str, mean: str) -> str:
    return f"""(SELECT CASE WHEN count(*) < 2 OR NOT coalesce(sum({mean} * (1 - {mean}) * (1 - 1 / n)) > 0, false) THEN 10.0::DOUBLE
        WHEN sum((k / n - {mean}) * (k / n - {mean}) - {mean} * (1 - {mean}) / n) <= 0 THEN 1000
        ELSE round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, sum({mean} * (1 - {mean}) * (1 - 1 / n)) / sum((k / n - {mean}) * (k / n - {mean}) - {mean} * (1 - {mean}) / n) - 1)), 3) END FROM {groups} WHERE n > 0)"""


URL_FILTER_SQL = f"""WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
marks AS (SELECT doc_id, min(CASE WHEN coalesce(toxic, 0) = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, regexp_extract(name, '([^.]*[.])?[^.]*$') AS two, two IN {url_filter.LONG_SUFFIXES} AS long FROM parts),
hosts AS (SELECT host, CASE WHEN long THEN two ELSE split_part(name, '.', -1) END AS suffix, CASE WHEN long THEN regexp_extract(name, '([^.]*[.])?[^.]*[.][^.]*$') ELSE two END AS domain,
    count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM named LEFT JOIN marks ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM domains) AS mean FROM domains GROUP BY 1),
s0 AS ({_strength_sql('suffixes', 'mean')[1:-1]} ), by_suffix AS (SELECT suffix, (k + mean * s) / (n + s) AS above FROM suffixes, s0 t(s)),
under_suffix AS (SELECT domains.*, above FROM domains JOIN by_suffix USING (suffix)),
s1 AS ({_strength_sql('under_suffix', 'above')[1:-1]} ), by_domain AS (SELECT domain, (k + above * s) / (n + s) AS above FROM under_suffix, s1 t(s)),
under_domain AS (SELECT hosts.*, above FROM hosts JOIN by_domain USING (domain)),
s2 AS ({_strength_sql('under_domain', 'above')[1:-1]} ), by_host AS (SELECT host, n, s AS s2, (k + above * s) / (n + s) AS rate FROM under_domain, s2 t(s)),
bounded AS (SELECT host, n::BIGINT AS n_labelled, rate, least(1.0::DOUBLE, rate + 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + s2 + 1))) AS upper FROM by_host),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict, n_labelled, round(rate, 6) AS rate, round(upper, 6) AS upper
FROM ruled JOIN bounded USING (host)"""
WORD_SQL = r"'[^\x20\x09-\x0D]+'"
QUALITY_SQL = f"""WITH split AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(t, {WORD_SQL}) AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD_SQL})) AS lines FROM documents),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
grams AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS place FROM often) GROUP BY r),
lines AS (SELECT r, doc_id, source, array_to_string(regexp_extract_all(translate(x, '{url_filter.UPPER}123456789', '{url_filter.LOWER}000000000'), {WORD_SQL}), ' ') AS key, len(regexp_extract_all(x, {WORD_SQL})) AS n
    FROM (SELECT r, doc_id, source, unnest(lines) AS x FROM split)),
hosts AS (SELECT source, count(DISTINCT doc_id) + count(*) FILTER (WHERE doc_id IS NULL) AS docs FROM split GROUP BY 1),
held AS (SELECT DISTINCT r, doc_id, source, key FROM lines),
counted AS (SELECT source, key, count(DISTINCT doc_id) + count(*) FILTER (WHERE doc_id IS NULL) AS docs_with FROM held GROUP BY ALL),
shared AS (SELECT counted.* FROM counted JOIN hosts ON counted.source IS NOT DISTINCT FROM hosts.source WHERE docs_with > {quality.MIN_DOCS} AND (docs_with > {quality.SHARE}::DOUBLE * docs OR docs_with > {quality.MANY})),
removed AS (SELECT r, sum(n)::BIGINT AS n FROM lines JOIN shared ON lines.source IS NOT DISTINCT FROM shared.source AND lines.key = shared.key GROUP BY r),
measured AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words FROM split LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT base_failed AND n_words - n_removed_words >= greatest({quality.LEAST_WORDS}, {quality.LEAST_SHARE}::DOUBLE * n_words) AS kept FROM measured"""


def _crc_step(n: int) -> int:
    """CRC-32 of half a byte."""
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 * (n & 1)
    return n


def _round_sql(value: str, key: int) -> str:
    return f"('0x' || substr(md5({value} || ':{key}'), 1, 12))::BIGINT"


#: Checksums go over half bytes, the lower first; rows walk the Feistel network until they are below n.
SHARDING_SQL = f"""WITH RECURSIVE sized AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
halves AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, list_transform(list_filter(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: c <> ''), lambda c: strpos('0123456789ABCDEF', c) - 1) AS h FROM sized),
summed AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(h, lambda crc, x: xor(crc >> 4, {[_crc_step(i) for i in range(16)]}[1 + (xor(crc, x) & 15)]), 4294967295::BIGINT)) AS text_crc32 FROM halves),
numbered AS (SELECT *, row_number() OVER (ORDER BY {_round_sql("concat_ws(':', doc_id, size, text_crc32)", 0)} % 4096, doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM summed),
radix AS (SELECT n, CASE WHEN (isqrt - 1) * (isqrt - 1) >= n THEN isqrt - 1 WHEN isqrt * isqrt >= n THEN isqrt ELSE isqrt + 1 END AS a FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS isqrt FROM numbered)),
bases AS (SELECT n, a, (n + a - 1) // a AS b FROM radix),
walks AS (SELECT x, x AS p, false AS passed FROM numbered
    UNION ALL SELECT x, l2 * b + r2, true FROM (SELECT *, (r1 + {_round_sql('l2', 3)}) % b AS r2 FROM (SELECT *, (l1 + {_round_sql('r1', 2)}) % a AS l2 FROM (SELECT *, (r0 + {_round_sql('l1', 1)}) % b AS r1
        FROM (SELECT *, (p // b + {_round_sql('r0', 0)}) % a AS l1 FROM (SELECT *, p % b AS r0 FROM walks, bases WHERE NOT passed OR p >= n)))))),
placed AS (SELECT x, p FROM walks, bases WHERE passed AND p < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INT AS shard, p // 8 AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed USING (x)"""
AUDIT_SQL = f"""WITH RECURSIVE marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
read AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(t, {WORD_SQL}) AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS f FROM read LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter), orders AS (SELECT '' AS o UNION ALL SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter)),
steps AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(o) = 5),
masks AS (SELECT filter_order, step, list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END))::INT AS before, 1 << (ascii(filter_order[step]) - 65) AS own FROM steps),
found AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE f & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE f & before = 0 AND f & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE f & before > 0 AND f & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE f = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE f & before = 0 AND f & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE f & before = 0 AND f & own > 0), 0)::BIGINT AS toxic_lost FROM counted, masks GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found"""


def _clustering_sql(rounds: int) -> str:
    """Assignments and means, one after another; distances are exact in double precision."""
    parts = ["""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < 16)"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(kept.v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
            FROM (SELECT kept.*, c, list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, c{i}.v) + list_inner_product(c{i}.v, c{i}.v) AS d FROM kept, c{i}) kept GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v FROM
                (SELECT c, pos, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY c, pos) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "op12_clustering": _clustering_sql(3), "op9_sharding": SHARDING_SQL, "op5_quality": QUALITY_SQL, "op10_url_filter": URL_FILTER_SQL}


def shipped(f):
    """f with this package made importable in Python workers first."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    return query
