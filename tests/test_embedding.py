"""Hashed text vectors, and the measures of responses that every signal of feedback stands on."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embedding, feedback


def vectors_of(spark, texts, dims):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    frequencies = spark.createDataFrame([("common", 90), ("worktree", 2)], "term string, df long")
    return {r.id: np.array(r.embedding) for r in embedding.embedded(df, frequencies, 100, dims).collect()}


def test_inner_products_are_those_of_tfidf(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(12)] + ["", None, "of the"]
    got = vectors_of(spark, texts, 256)
    assert set(got) == set(range(12)) and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    weight = np.log(101) + 1
    plain = []
    for t in texts[:12]:
        c = {w: t.split().count(w) for w in t.split()}
        v = np.array([(0.5 + 0.5 * c[w] / max(c.values())) * weight if w in c else 0.0 for w in words])
        plain.append(v / np.linalg.norm(v))
    error = [abs(got[i] @ got[j] - plain[i] @ plain[j]) for i in range(12) for j in range(i)]
    assert max(error) < 0.25 and np.mean(error) < 0.08


def test_rare_terms_weigh_more(spark):
    v = vectors_of(spark, ["common worktree", "common", "worktree"], 256)
    assert v[0] @ v[2] > v[0] @ v[1] > 0


def test_measures_and_all_families(spark):
    long = "The worktree locks keep parallel sessions apart from each other in every repository"
    recalled = spark.createDataFrame([(k, i, t) for k in range(6) for i, t in ((1, long), (2, "Billing exports run nightly against invoices"))], "key long, node long, text string")
    asked = spark.createDataFrame([
        (0, f"{long}. {long}.", f"{long} indeed."),  # deep, like, on topic
        (1, "ok", None),  # nearly empty, short
        (2, f"{long}.", "Penguins swim across antarctic waters. Volcanoes erupt beneath glaciers today. Bakeries sell croissants every morning. Violins accompany operas throughout Europe."),  # parroted, then off topic and sprawling
        (3, "Penguins swim across antarctic waters while volcanoes erupt beneath glaciers and bakeries sell croissants", long),  # unlike and off topic, then rising
        (4, None, ""), (7, long, long),  # nothing said; nothing recalled
        (5, "Penguins worktree antarctic volcanoes glaciers bakeries croissants violins locks", None),  # hardly like
    ], "key long, response string, followup string")
    frequencies = spark.createDataFrame([], "term string, df long")
    rows = {r.key: r for r in embedding.measures(asked, recalled, frequencies, 100, 256).collect()}
    assert rows[0].resp_sim > 0.9 and rows[0].resp_on_topic == 1.0 and rows[0].depth_ratio > 0.3 and rows[0].fup_sim > 0.8
    assert rows[1].resp_words == 1 and rows[1].depth_ratio < 0.05 and rows[4].resp_words == 0 == rows[4].resp_sim
    assert rows[2].fup_sentences == 4 and rows[2].fup_on_topic == 0 and rows[2].fup_sim < 0.4 and rows[3].resp_on_topic == 0
    assert rows[7].resp_sim == rows[7].resp_on_topic == 0 and rows[7].depth_ratio == len(long)
    marked = feedback.signals(embedding.measures(asked, recalled, frequencies, 100, 256).withColumn("text", F.lit("hm")))
    flags = marked.select("key", *[v.alias(k) for k, v in feedback._measured(marked.columns).items()]).collect()
    on = {k for r in flags for k, v in r.asDict().items() if k != "key" and v}
    assert on >= {"deep_response", "like_response", "rising", "on_topic", "empty_response", "short_response", "unlike_response", "falling", "off_topic", "parroting", "sprawl"}


def test_whole_recalled_texts_count(spark, tmp_path):
    """A response is measured against all of what was recalled (before, against the first 200 characters); evidence keeps the cut that its SQL has."""
    from tessera.plans import catalog

    long = "worktree locks keep sessions apart " + "filler words without meaning here " * 12 + "penguins swim across antarctic waters"
    spark.createDataFrame([(i, t) for i, t in enumerate([long, "billing exports run nightly", "something else entirely"])], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    answer = "penguins swim across antarctic waters filler words without meaning here"
    spark.createDataFrame([(1, 0, "user", "worktree locks"), (1, 1, "assistant", answer), (1, 2, "user", "filler words")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = catalog.QUERIES["q_response_measures"](spark, str(tmp_path)).first()
    assert abs(r.depth_ratio - len(answer) / len(long)) < 1e-5 and r.resp_sim > 0.8
    assert "200" not in catalog.ORACLE_SQL["q_response_measures"] and "substring(d.text, 1, 200)" in catalog.ORACLE_SQL["q_evidence"]
