import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import DataFrame

from gleaner.config import STOP_WORDS
from gleaner.operators import dense, retrieval

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "the", "of", "kappa", "sigma", "zeta"]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    # "hot" stands in every chunk: one term owns the largest part of all pairs
    return [(f"d{i // 4}::c{i}", "hot " + " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(n)]


def terms(text):
    return [t for t in re.findall(r"\w\w+", text.lower()) if t not in STOP_WORDS]


def brute(chunks, queries, k):
    n = len(chunks)
    tfs = {c: Counter(terms(t)) for c, t in chunks}
    df = Counter(t for tf in tfs.values() for t in tf)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}

    def unit(tf):
        w = {t: f * idf[t] for t, f in tf.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    vecs = {c: unit(tf) for c, tf in tfs.items()}
    out = {}
    for q, text in queries:
        qv = unit(Counter(terms(text)))
        scored = sorted((-round(sum(qv.get(t, 0) * x for t, x in v.items()), 9), c) for c, v in vecs.items())
        out[q] = [c for _, c in scored[:k]]
    return out


QUERIES = [(1, "alpha beta"), (2, "unknownword"), (3, "the of"), (4, "hot zeta zeta"), (5, "")]


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("terms_in_broadcast", [1_000_000, 2])
def test_matches_brute_force(spark, terms_in_broadcast, monkeypatch):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    model = retrieval.fit(chunks, broadcast_terms=terms_in_broadcast)
    assert model.small == (terms_in_broadcast > 2)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 7)
    want = brute(rows, QUERIES, 12)
    assert ranked(retrieval.retrieve(queries, chunks, 12, model)) == want
    assert ranked(retrieval.retrieve(queries, chunks, 12, model, query_block=0)) == want  # terms are joined


@pytest.mark.parametrize("scope", [(), ("split",)])
def test_large_vocabulary_emits_no_pairs(spark, scope, monkeypatch):
    """Over a vocabulary that does not fit, chunks meet their norms and only the best leave a task."""
    rows = corpus()
    chunks = spark.createDataFrame([("x", *r) for r in [*rows, ("d9::e", "")]], "split string, chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([("x", *q) for q in QUERIES], "split string, query_id long, query_text string")
    model = retrieval.fit(chunks, scope, broadcast_terms=2)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(retrieval, "scores", lambda *a: pytest.fail("a row per pair"))
    assert ranked(retrieval.retrieve(queries, chunks, 12, model)) == brute([*rows, ("d9::e", "")], QUERIES, 12)


@pytest.mark.parametrize("scope", [(), ("split",)])
def test_large_vocabulary_needs_no_norms_of_all_chunks(spark, scope, monkeypatch):
    """Bounds decide, and only what they leave meets its rare terms; copies and overlong terms included."""
    rng = random.Random(5)
    rows = [(c, f"{t} rare{rng.randint(0, 30)} rare{i % 7} once{i}") for i, (c, t) in enumerate(corpus(80))]
    rows += [(f"e{i:02}::c0", "alpha beta rare3") for i in range(40)]
    rows += [(f"f{i}::c0", f"alpha beta {'x' * 300} once{i}") for i in range(5)] + [("g::c0", "")]
    asked = [*QUERIES, (6, "rare3 alpha"), (7, "once4 once5 " + "x" * 300)]
    chunks = spark.createDataFrame([("x", *r) for r in rows], "split string, chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([("x", *q) for q in asked], "split string, query_id long, query_text string")
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_ROWS", 4)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(retrieval.Postings, "norms", property(lambda self: pytest.fail("norms of all chunks")))
    kept = retrieval.index(chunks, scope)
    assert not kept.model.small
    assert ranked(retrieval.retrieve(queries, kept, 12)) == brute(rows, asked, 12)


def test_large_query_side_takes_the_shuffle_plan(spark, monkeypatch):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    kept = retrieval.index(chunks)
    a = {(r.query_id, r.chunk_no): round(r.score, 9) for r in retrieval.scores(queries, kept).collect()}
    b = {(r.query_id, r.chunk_no): round(r.score, 9) for r in retrieval.scores(queries, kept, 1, salt_rows=7).collect()}
    monkeypatch.setattr(retrieval, "fits_broadcast", lambda *a, **k: False)  # not even the terms fit
    c = {(r.query_id, r.chunk_no): round(r.score, 9) for r in retrieval.scores(queries, kept, 1, salt_rows=7).collect()}
    assert a == b == c and len(a) > 12


def test_small_corpus_and_padding(spark):
    chunks = spark.createDataFrame([("b", "alpha"), ("a", "beta"), ("c", "gamma")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "gamma"), (2, "nothing")], "query_id long, query_text string")
    assert ranked(retrieval.retrieve(queries, chunks, 12)) == {1: ["c", "a", "b"], 2: ["a", "b", "c"]}


def test_queries_without_a_known_term(spark):
    rows = corpus(20)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = [(1, "nothing"), (2, "the of")]
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    for block in (1024, 0):
        assert ranked(retrieval.retrieve(queries, chunks, 3, query_block=block)) == brute(rows, asked, 3)
    assert retrieval.retrieve(queries.limit(0), chunks, 3).collect() == []


def test_scopes_are_fitted_apart(spark):
    rows = corpus()
    parts = {"x": rows[:30], "y": rows[30:]}
    chunks = spark.createDataFrame([(s, *r) for s, rs in parts.items() for r in rs], "split string, chunk_id string, text string")
    queries = spark.createDataFrame([("x", 1, "alpha beta"), ("y", 4, "hot zeta zeta")], "split string, query_id long, query_text string")
    got = ranked(retrieval.retrieve(queries, chunks, 5, scope=["split"]))
    assert got[1] == brute(parts["x"], [(1, "alpha beta")], 5)[1]
    assert got[4] == brute(parts["y"], [(4, "hot zeta zeta")], 5)[4]


def test_empty_vocabulary_raises(spark):
    chunks = spark.createDataFrame([("a", "the of")], "chunk_id string, text string")
    with pytest.raises(ValueError):
        retrieval.fit(chunks, refuse_empty=True)


def test_baselines_and_labels(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.4, 1), (1, "c", 0.1, 2)], "query_id long, chunk_id string, score double, rank int")
    assert retrieval.select_by_score(df, 0.4).count() == 2
    assert retrieval.select_top_k(df, 1).count() == 1
    ev = spark.createDataFrame([(1, "b"), (1, "zz")], "query_id long, chunk_id string")
    assert {r.chunk_id: r.label for r in retrieval.assign_labels(df, ev).collect()} == {"a": 0, "b": 1, "c": 0}


def test_dense_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(50, 6)), rng.normal(size=(9, 6))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {i: list(np.argsort(-cos[i], kind="stable")[:4]) for i in range(9)}
    assert ranked(dense.cosine_top_k(queries, vectors, 4)) == want
    assert ranked(dense.cosine_top_k(queries, vectors, 4, max_queries=3)) == want


def test_latent_space_matches_dense_svd(spark):
    import numpy as np

    rows = corpus(40)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    space = dense.fit_latent(chunks, components=3)
    got = {r.chunk_id: r.vector for r in dense.latent_vectors(space, chunks, "chunk_id").collect()}
    n = len(rows)
    tfs = [Counter(terms(t)) for _, t in rows]
    vocab = sorted({t for tf in tfs for t in tf})
    df = Counter(t for tf in tfs for t in tf)
    a = np.array([[tf[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in vocab] for tf in tfs])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :3] * s[:3]
    have = np.array([got[c] for c, _ in rows])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-3)


def test_latent_space_keeps_its_rows_for_all_steps(spark, monkeypatch):
    """The decomposition reads its rows hundreds of times: kept, and not by way of Python."""
    seen, plain = [], dense.RowMatrix

    def watched(rows, *sizes):
        seen.append((rows, isinstance(rows, DataFrame), rows.is_cached))
        return plain(rows, *sizes)

    monkeypatch.setattr(dense, "RowMatrix", watched)
    dense.fit_latent(spark.createDataFrame(corpus(20), "chunk_id string, text string"), components=2)
    [(rows, native, kept)] = seen
    assert native and kept and not rows.is_cached


def test_latent_space_of_texts_without_terms(spark):
    for rows in ([], [("a", "the of")], [("a", "alpha"), ("b", None)]):
        chunks = spark.createDataFrame(rows, "chunk_id string, text string")
        queries = spark.createDataFrame([(1, "alpha"), (2, "")], "query_id long, query_text string")
        got = dense.latent_retrieve(queries, chunks).collect()
        assert len(got) == 2 * len(rows)


def test_latent_vectors_are_compared_in_a_stage_of_their_own(spark):
    chunks = spark.createDataFrame(corpus(40), "chunk_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    plan = dense.latent_retrieve(queries, chunks, components=3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan  # one Python worker a core


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_dense_blocks_keep_the_best(spark, block, monkeypatch):
    rng = random.Random(5)
    rows = [(f"v{i:03d}", [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)]  # many ties
    asked = [(q, [float(rng.randint(-1, 1)) for _ in range(3)]) for q in range(5)]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    monkeypatch.setattr(dense, "VECTOR_BLOCK", block)
    found = dense.cosine_top_k(
        spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(rows, "chunk_id string, vector array<double>"), 12
    )
    assert ranked(found) == {q: [c for _, c in sorted((-round(cosine(v, w), 9), c) for c, w in rows)[:12]] for q, v in asked}
