"""Cases that once got less than the whole job."""

import random

from pyspark.sql import functions as F

from tessera.llm import langid, quality, simhash

DOCS = "doc_id long, text string, lang string, source string"


def words(n, seed, vocabulary=20_000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def kept_by_similarity(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "h") for i, t in enumerate(texts)], DOCS).repartition(3)
    return sorted(r.doc_id for r in simhash.keep_one(docs, simhash.similar(0.8)).collect())


def test_near_copies_with_a_repeated_shingle_are_found(spark):
    texts = []
    for seed, (n, share) in enumerate([(1000, 0.03), (3000, 0.02), (1000, 0.15)]):
        own = words(n, seed)
        texts += [" ".join(own), " ".join(own + ["--"] * int(n * share))]
    assert kept_by_similarity(spark, texts) == [0, 2, 4]


def test_a_shared_filler_does_not_make_texts_equal(spark):
    filler = "-- " * 200
    assert kept_by_similarity(spark, [filler + " ".join(words(60, seed)) for seed in (1, 2, 3)]) == [0, 1, 2]


def test_texts_of_one_fingerprint_pass_the_exact_check_too(spark, monkeypatch):
    made = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made(*a).withColumns({f"f{i}": F.lit(7).cast("long") for i in range(4)}))
    assert kept_by_similarity(spark, [" ".join(words(300, seed)) for seed in (1, 2, 1)]) == [0, 1]


def test_groups_whose_forest_fails_are_compared_exactly(spark, monkeypatch):
    """Edited copies of one template with similarities around the threshold, against all pairs."""
    rng, base, texts = random.Random(3), words(200, 9), []
    for _ in range(150):
        own = list(base)
        for i in rng.sample(range(200), rng.randint(2, 5)):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want, left = [], set(range(len(texts)))
    while left:
        group = [min(left)]
        want.append(group[0])
        left.discard(group[0])
        while group:
            a = sets[group.pop()]
            near = {j for j in left if len(a & sets[j]) >= 0.8 * len(a | sets[j])}
            left -= near
            group += near
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 4000)
    assert len(want) > 5 and kept_by_similarity(spark, texts) == want


def test_a_failed_link_is_replaced(spark, monkeypatch):
    made = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made(*a).withColumns({f"f{i}": F.lit(7).cast("long") for i in range(4)}))
    texts = [" ".join(words(300, seed)) + end for seed in range(6) for end in ("", " end")]
    assert kept_by_similarity(spark, texts) == [0, 2, 4, 6, 8, 10]


def test_lines_survive_where_their_first_document_fails(spark):
    """The first copy fails the base rules; of the others one stays. A keeper that would be depleted stays whole."""
    lines = [" ".join(words(12, seed)) for seed in range(20)]
    lines = [x.translate(str.maketrans("0123456789", "abcdefghij")) for x in lines]  # digits are all alike in lines
    copies = [(0, "\n".join(lines[:4] * 2), "en", "h")] + [(i, "\n".join([*lines[:4], f"copy {chr(96 + i)}"]), "en", "h") for i in range(1, 9)]
    # 20 keeps line 4 alone, for what else it has is kept by documents before it.
    mixed = [(i, "\n".join([*lines[:4], lines[4], f"more {chr(77 + i)}"]), "en", "h") for i in range(20, 28)]
    kept = {r.doc_id: r.text for r in quality.apply_quality_rules(spark.createDataFrame(copies + mixed, DOCS)).collect()}
    assert set(kept) == {1, 20}
    assert all(any(x in t for t in kept.values()) for x in lines[:5])


LETTERS = {"en": "etaoinshrdlu", "xx": "zqkvwyjxpbmg"}


def language_text(lang, seed, n):
    rng, vocabulary = random.Random(seed), random.Random(lang)
    known = ["".join(vocabulary.choice(LETTERS[lang]) for _ in range(vocabulary.randint(3, 8))) for _ in range(3000)]
    return " ".join(rng.choice(known) for _ in range(n))


def test_margins_do_not_fall_with_the_length(spark):
    rows = [(f"{lang}", language_text(lang, i, 300)) for lang in LETTERS for i in range(40)]
    training = spark.createDataFrame(rows, "lang string, text string")
    compressors = langid._compressors(tuple(sorted(langid.sample(training, "text", "lang").items())))
    short, long = (langid.classify(language_text("xx", 99, n), compressors) for n in (2_500, 500_000))
    assert short[0] == long[0] == "xx" and long[1] > 0.5 * short[1] > langid.MARGIN


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [("en", language_text("en", i, 100)) for i in range(20)] + [("xx", language_text("xx", i, 2000)) for i in range(5)]
    found = langid.sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert set(found) == {"en", "xx"} and len(found["xx"]) <= 5 * (langid.TEXT_BYTES + 1)


def test_names_that_clash_do_no_harm(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a", "b"), (2, "one two three four five six", "c", "d"), (2, "another text of its own here", "e", "f")], "doc_id long, text string, `_copy` string, `_repeated` string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2][: kept.count()]


def test_components_of_dense_groups(spark, monkeypatch):
    """Pairs are thinned in several tasks, and the roots are those of all pairs."""
    from tessera.llm import components

    monkeypatch.setattr(components, "LOCAL", 500)
    rng = random.Random(4)
    pairs = [(g * 1000 + rng.randrange(60), g * 1000 + rng.randrange(60)) for g in range(5) for _ in range(800)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    roots = {}
    for x in sorted({x for p in pairs for x in p}):
        roots.setdefault(x // 1000, x)
    assert got == {x: roots[x // 1000] for p in pairs for x in p if x != roots[x // 1000]}
