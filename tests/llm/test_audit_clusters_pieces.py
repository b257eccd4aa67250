"""Filter audit, annulus clustering and piece encoding against brute force and the sentencepiece library, on hard inputs too."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import annulus, audit, pieces
from tessera.llm import queries as Q

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, part string, id long, digest string, _text string, v int, ids string"
LABELS = "doc_id long, quality int, toxic int, good string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    Q.ship_code(spark)


def hard_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts = [None, "", " \n\t\x0b ", "one", "ABC DEF GHI", "a|b", "été ﬁn İ  x y", "tab\tand\rreturn\x0cfeed", "w " * 300, "😀" * 20]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (199, 200, 201, 260, 900, 20_000)] + [" ".join(vocabulary[:250]) + end for end in ("", " #", " UPPER UPPER UPPER", " & UPPER UPPER UPPER UPPER")]
    rows = [(i, t, "en", [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts * 2)]
    rows += [rows[12], (None, texts[13], None, "a"), (None, texts[13], None, "a"), (500, "alone", None, "c"), (None, None, None, None)]
    return [(*r, "p", 7, "d", "t", 1, "i") for r in rows]


def failing(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for doc_id, text, _, source, *_ in rows:
        t, w = text or "", WORD.findall(text or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and first[t] < doc_id}
        yield doc_id, source or "", {f for f, bad in fails.items() if bad}


def test_audit_equals_filters_applied_in_turn(spark):
    rows = hard_rows()
    labels = [(1, 1, 0, "g"), (1, 0, 1, "g"), (3, None, 1, None), (None, 1, 1, None), (15, 1, None, None), (15, 1, None, None), (35, 1, 0, None), (36, 1, 1, None)]
    good, toxic = {x[0] for x in labels if x[1] == 1 and x[0] is not None}, {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    judged, want = list(failing(rows)), []
    for part in sorted({p for _, p, _ in judged}):
        own, removals = [(i, f) for i, p, f in judged if p == part], []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removals.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        shapley = Counter()
        for r in removals:
            shapley[r[1][r[2] - 1]] += r[4]
        want += [(*r, shapley[r[1][r[2] - 1]]) for r in removals]
    got = audit.audit_documents(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_audit_walks_each_state_once_and_frees_it(spark):
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, True, False) for i in range(60)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, good boolean, toxic boolean")
    states = [r.state for r in audit.count_edges(rows, "ABC").collect()]
    assert sorted(states) == sorted(audit.states("ABC")) == ["", "A", "AB", "AC", "B", "BC", "C"]
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    audit.audit(rows, "ABC").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    with pytest.raises(ValueError):
        audit.audit(rows, "ABCDEFGH")


def test_audit_of_nothing(spark):
    assert audit.audit_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def lloyd(rows, k, rounds, dims, scale):
    """(id, cluster, distance, inertia of the cluster, inertia, digest), in whole numbers, every centroid tried."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for c in range(len(centroids)):
                if own := [v for (_, v), (_, i) in zip(kept, near) if i == c]:
                    centroids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)]


def by_text(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("spread", [0.3, 30.0])
def test_clusters_equal_lloyd(spark, spread):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) * rng.choice([1, spread]) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[i % 3][1]) for i in range(400, 460)] + [rows[5], rows[5], (None, rows[9][1]), (None, rows[8][1]), (901, [0.0] * 6), (902, [-0.0] * 6), (903, [1e3] * 6)]
    rows += [(700, None), (701, []), (702, [1.0] * 5), (703, [1.0] * 7), (704, [None] + [1.0] * 5), (705, [float("nan")] + [1.0] * 5), (706, [float("inf")] * 6), (707, [-float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "vec_id long, embedding array<double>, v int, cluster string, distance int").repartition(6)
    got = annulus.cluster(df, k=16, rounds=3, dims=6, scale=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert by_text(got.collect()) == by_text(lloyd(rows, 16, 3, 6, 64))


def test_few_vectors_and_ties(spark):
    """Two centroids at the same distance, on the rim of the annulus: the smaller number; fewer vectors than clusters; none."""
    shape = "vec_id long, embedding array<float>"
    rows = [(i, [float(x), 0.0]) for i, x in enumerate((1, -1, 0, 0, 3, -3))]
    assert by_text(annulus.cluster(spark.createDataFrame(rows, shape), k=3, rounds=0, dims=2, scale=64).collect()) == by_text(lloyd(rows, 3, 0, 2, 64))
    assert by_text(annulus.cluster(spark.createDataFrame(rows[:2], shape), k=16, rounds=2, dims=2, scale=64).collect()) == by_text(lloyd(rows[:2], 16, 2, 2, 64))
    assert annulus.cluster(spark.createDataFrame([], shape), k=4, rounds=1, dims=2, scale=64).collect() == []


def test_annulus_leaves_out_most_centroids():
    """Centroids of very different norms: few are compared, and the nearest is always among them."""
    rng = np.random.default_rng(2)
    c = np.floor(rng.normal(size=(500, 8)) * np.geomspace(1, 1e5, 500)[:, None]).astype(np.int64)
    x = c[rng.integers(0, 500, 2000)] + rng.integers(-2, 3, (2000, 8))
    tree, all_d = annulus.Annulus(c), ((x[:, None, :] - c[None]) ** 2).sum(2)
    for before in (np.full(2000, -1), all_d.argmin(1)):
        found, distance = tree.nearest(x, before)
        assert (found == all_d.argmin(1)).all() and (distance == all_d.min(1)).all()
    low, high = tree.span((x * x).sum(1), all_d.min(1))
    assert (high - low).mean() < 25
    large = x * (1 << 24)  # sums of products beyond what floating point holds
    assert (annulus.Annulus(c * (1 << 8)).nearest(large // (1 << 16), np.full(2000, -1))[0] == all_d.argmin(1)).all()


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        annulus.quantised(spark.createDataFrame([(1, [1e18, 1.0])], "vec_id long, embedding array<double>"), 2, 64).collect()


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    own = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = [r[1] for r in hard_rows()] + ["<s> </s> <unk> <0x41>", "▁ ▁▁x", "a\0b\r\n\n", " " * 5000 + "x" + " " * 33, "ab" * 40_000, "中文字符\U0001f600\U000e0001٣²½_x.9", "x" * 200 + "," * 200]
    texts += ["".join(rng.choice(own) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["".join(rng.choice("  \t\n.,a1é中▁😀the") for _ in range(80)) for _ in range(300)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", "count") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string").repartition(3)
    got = pieces.encode_decode(docs, MODEL, outputs=("ids", "text"))
    want = [(i if i % 7 else None, ids, library.decode(ids)) for i, ids in enumerate(library.encode([t or "" for t in texts]))]
    assert by_text(got.collect()) == by_text(want)
    digests = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for i, ids, text in want]
    assert by_text(pieces.encode_decode(docs, MODEL, outputs=("digests",)).collect()) == by_text(digests)
    assert pieces.encode_decode(docs.limit(0), MODEL).collect() == []


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 50)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(MODEL), random.Random(1)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefgh.") for _ in range(rng.randint(1, 9))) for _ in range(60))
        ids = library.encode(text)
        assert model.digests(text)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert len(model.parts) <= 50 and len(model.older) <= 50 and len(model.pairs) <= 50


def test_bytes_that_are_no_text_decode_as_in_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(MODEL)
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_piece_query_covers_every_document(spark):
    got = Q.op13_sentencepiece(spark, "/root/testdata/sf0.001").select(F.sum("n_tokens"), F.count("doc_id")).first()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert tuple(got) == (sum(map(len, library.encode(texts))), len(texts))
