import bisect
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gleaner.config import NUMERIC_FEATURES
from gleaner.operators import features, metrics, rules, scoring, splits
from gleaner.sources import artifacts

PAIRS = (
    "query_id long, query_text string, chunk_id string, doc_id string, position int, text string,"
    " doc_title string, heading string, source_type string, score double, rank int"
)


def test_features(spark):
    rows = [
        (1, "How do I reset my password?", "a::c0", "a", 0, "To reset your password open Settings", "Guide", "Password", "prose", 0.6, 0),
        (1, "How do I reset my password?", "a::c1", "a", 1, "404 500", "Guide", None, "table", 0.02, 1),
        (1, "How do I reset my password?", "b::c0", "b", 0, "curl -X POST", "Api", "", "code", 0.0, 2),
    ]
    got = {r.chunk_id: r for r in features.extract_features(spark.createDataFrame(rows, PAIRS)).collect()}
    a, n, c = got["a::c0"], got["a::c1"], got["b::c0"]
    assert a.tfidf_similarity == 0.6 and a.score_margin == 0.0 and n.score_margin == pytest.approx(0.58)
    assert a.query_token_overlap_ratio == pytest.approx(2 / 6)
    assert a.title_or_heading_overlap == pytest.approx(1 / 6)
    assert n.query_token_overlap_ratio == 0 and n.exact_phrase_overlap == 0
    assert a.normalized_chunk_length == 1.0 and n.normalized_chunk_length == pytest.approx(2 / 6)
    assert a.neighbor_relevance == pytest.approx(0.02) and n.neighbor_relevance == 0.6 and c.neighbor_relevance == 0
    assert c.source_type == "code" and c.feature_version == "v1"


def example_rows(n=200, seed=2):
    rng = random.Random(seed)
    for i in range(n):
        label = int(rng.random() < 0.25)
        x = [rng.gauss(0.4 * label, 0.2) for _ in NUMERIC_FEATURES]
        x[-1] = 7.0  # a constant column stays unscaled
        split = ("train", "val", "test")[0 if i < 120 else 1 if i < 160 else 2]
        yield (i // 4, i % 4, f"c{i}", split, *x, rng.choice(["prose", "code", "odd"]), label)


@pytest.fixture(scope="module")
def examples(spark):
    cols = ", ".join(f"{c} double" for c in NUMERIC_FEATURES)
    return spark.createDataFrame(
        list(example_rows()), f"query_id long, rank int, chunk_id string, split string, {cols}, source_type string, label int"
    ).cache()


def test_scaling_and_weights(spark, examples):
    scaler = scoring.fit_scaler(examples)
    assert scaler.std[-1] == 1.0
    row = examples.select(*scoring.model_columns(scaler)).agg(F.avg("tfidf_similarity"), F.stddev_pop("tfidf_similarity"), F.max("is_other")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 0.0
    weighted = scoring.balanced_weights(examples).groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert weighted[0].s == pytest.approx(weighted[1].s)


def test_train_save_load(spark, examples, tmp_path):
    model = scoring.fit_logistic(examples.filter("split = 'train'"))
    held = scoring.predict(examples.filter("split <> 'train'"), model)
    means = {r.label: r.s for r in held.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert means[1] > means[0] + 0.3
    with pytest.raises(ValueError):
        scoring.fit_logistic(examples.filter("label = 0"))

    folder = str(tmp_path / "models")
    assert artifacts.resolve_latest_version(spark, folder) is None
    assert artifacts.allocate_next_version(spark, folder).endswith("/v1")
    assert artifacts.resolve_latest_version(spark, folder) is None  # taken, but not published
    meta = scoring.Metadata("c", "now", "v1", 1, 1, 1, 0.5, {"f1": 1.0}, {})
    for n in (2, 10, 9):
        artifacts.save(spark, f"{folder}/v{n}", model, meta)
    assert artifacts.resolve_latest_version(spark, folder).endswith("/v10")
    assert artifacts.allocate_next_version(spark, folder).endswith("/v11")
    again, meta2 = artifacts.load_model_or_raise(spark, f"{folder}/v10")
    assert again == model and meta2 == meta
    old = scoring.Metadata("c", "now", "v0", 1, 1, 1, 0.5, {}, {})
    artifacts.save(spark, f"{folder}/v12", model, old)
    for bad in (f"{folder}/v12", f"{folder}/v99", None):
        with pytest.raises(artifacts.ModelLoadError):
            artifacts.load_model_or_raise(spark, bad)
    assert artifacts.load_or_none(spark, f"{folder}/v12") is None


def test_forest(spark, examples):
    train = examples.filter("split = 'train'")
    scaler = scoring.fit_scaler(train)
    forest = scoring.fit_forest(train, scaler, trees=10)
    got = scoring.score_forest(forest, scaler, examples, "label").groupBy("label").agg(F.avg("score").alias("s")).collect()
    means = {r.label: r.s for r in got}
    assert means[1] > means[0]


def test_threshold_ties_go_low(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.02)], "label int, score double")
    assert scoring.select_threshold(df).first().threshold == pytest.approx(0.15)


def test_prune_without_model_keeps_everything(spark):
    chunks = spark.createDataFrame(
        [("d", f"d::c{i}", f"alpha text {i}", "prose", "T", None, i, 5) for i in range(5)],
        "doc_id string, chunk_id string, text string, source_type string, doc_title string, heading string, position int, doc_chunk_count int",
    )
    queries = spark.createDataFrame([(1, "alpha"), (2, "nothing known")], "query_id long, query_text string")
    decided = scoring.prune(queries, chunks, None)
    totals = {r.query_id: r for r in rules.summarise(decided).collect()}
    assert totals[1].kept_chunks == 5 and totals[1].tokens_saved == 0 and not totals[1].pruning_enabled
    model = scoring.LogisticModel(scoring.Scaler((0.0,) * 9, (1.0,) * 9), (1.0,) * 13, -40.0)
    rows = scoring.prune(queries, chunks, model, policy={"threshold": 0.5, "min_context": 1, "token_budget": 1}).collect()
    kept = {r.query_id: r for r in rows if r.kept}
    assert set(kept) == {1, 2} and all(r.safety_override == "top_ranked_result" for r in kept.values())


def test_metrics(spark):
    exact = spark.createDataFrame([(1, 1.0), (0, 0.0)], "label int, score double")
    off = spark.createDataFrame([(0, 0.95), (0, 0.9)], "label int, score double")
    ece = lambda d: metrics.expected_calibration_error(d).first()[0]
    assert ece(exact) == 0 and ece(off) > 0.5
    none = spark.createDataFrame([(0, 0)], "label int, pred int")
    assert tuple(metrics.classification_metrics(none).first()) == (0.0, 0.0, 0.0, 0.0)

    runs = {"a": [1, 1, 0.5, 0.5, 1, 0.8, 1, 1], "b": [1, 0.5, 0.5]}
    rows = [(p, i, i // 3, float(r), 2, int(2 * r)) for p, rs in runs.items() for i, r in enumerate(rs)]
    trials = spark.createDataFrame(rows, "policy string, i long, _slice int, recall double, relevant_total long, relevant_retained long")
    found = metrics.recovery_trials(trials, ["policy"], "_slice", [F.col("i")])
    assert sorted((r.policy, r.trials_to_recover) for r in found.collect()) == [("a", 1), ("a", 2)]
    mean = {r.policy: r.mean_recovery_trials for r in metrics.mean_recovery(trials, ["policy"], found).collect()}
    assert mean == {"a": 1.5, "b": None}
    curves = metrics.cumulative_curves(trials, ["policy"], "_slice", [F.col("i")]).collect()
    assert all(r.cumulative_recall + r.cumulative_false_pruning == pytest.approx(1) for r in curves)
    last = {r.policy: r.cumulative_recall for r in sorted(curves, key=lambda r: r.i)}
    summary = {r.policy: r.final_cumulative_recall for r in metrics.policy_summary(trials, ["policy"], "_slice", [F.col("i")]).collect()}
    assert summary == pytest.approx(last)


def test_order_statistics_with_a_hot_value(spark):
    rng = random.Random(1)
    values = [7.0] * 300 + [rng.random() * 20 for _ in range(501)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(6)
    ordered = sorted(values)
    assert metrics.median_latency(df, "v", ["k"], slices=5).first().median_value == ordered[400]
    for pct in (0.0, 0.5, 0.9, 1.0):
        got = metrics.latency_percentile(df, pct, "v", slices=5).first().percentile_value
        assert got == ordered[min(800, max(0, round(pct * 800)))]


def test_splits(spark):
    docs = spark.createDataFrame([(f"d{i}", "en" if i % 3 else "fr") for i in range(90)], "doc_id string, doc_type string")
    got = splits.split_by_document(docs, seed=1)
    counts = {(r.doc_type, r.split): r["count"] for r in got.groupBy("doc_type", "split").count().collect()}
    assert counts == {("en", "train"): 36, ("en", "val"): 12, ("en", "test"): 12, ("fr", "train"): 18, ("fr", "val"): 6, ("fr", "test"): 6}
    again = splits.split_by_document(docs.repartition(7), seed=1)
    assert got.exceptAll(again).isEmpty() and not got.exceptAll(splits.split_by_document(docs, seed=2)).isEmpty()

    by = {s: [r.doc_id for r in got.filter(F.col("split") == s).collect()] for s in ("train", "val")}
    t, v = by["train"], by["val"]
    rows = [(1, f"{t[0]}::c0"), (2, f"{t[0]}::c0"), (2, f"{t[1]}::c0"), (2, f"{v[0]}::c0"), (3, f"{t[0]}::c1"), (3, f"{v[0]}::c1")]
    ev = spark.createDataFrame(rows, "query_id long, chunk_id string")
    asked = splits.assign_question_splits(ev, got)
    assert {r.query_id: r.split for r in asked.collect()} == {1: "train", 2: "train", 3: None}
    checks = splits.check_invariants(docs, got, ev, asked).collect()
    assert len(checks) == 4 and all(r.violations == 0 for r in checks)


def test_costs_and_report(spark):
    prices = spark.createDataFrame([("p", "m", 3.0, 15.0, "v")], "provider string, model string, input_per_million double, output_per_million double, pricing_version string")
    usage = spark.createDataFrame([("p", "m", 1_000_000, 0), ("p", "x", 1_000_000, 5)], "provider string, model string, input_tokens long, output_tokens long")
    got = {r.model: r for r in metrics.estimate_cost(usage, prices).collect()}
    assert got["m"].total_cost_usd == 3.0 and got["m"].known
    assert got["x"].total_cost_usd == 0.0 and not got["x"].known
    held = spark.createDataFrame([("pruner", 0.5, 0.25, 0.4), ("top_k", 0.3, 0.2, 0.1), ("retrieval_threshold", 0.2, 0.1, 0.9)], "method string, recall double, precision double, token_reduction_pct double")
    meta = spark.createDataFrame([("c", "now", "v1", 7)], "corpus_id string, trained_at string, feature_version string, num_questions long")
    row = metrics.render_report(spark, held, meta).first()
    assert "| model and rules | 50% | 25% | 40% |" in row.report and row.banned_claim is None


def test_null_scores_clear_no_threshold(spark):
    rows = spark.createDataFrame([(1, 0.99), (1, None), (0, None)], "label int, score double")
    got = scoring.threshold_table(rows).collect()
    assert all(r.recall == 0.5 and r.precision == 1.0 for r in got)


def test_best_of_all_batches_leaves_a_task_once(spark):
    from gleaner.operators import dense

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = [(f"c{i:04d}", [float(i % 97), 1.0 + i % 13]) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    got = dense.cosine_top_k(asked, vectors, k=5).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, v in ((1, (1.0, 0.0)), (2, (0.0, 1.0))):
        cos = {c: round((v[0] * x + v[1] * y) / (x * x + y * y) ** 0.5, 9) for c, (x, y) in rows}
        want = sorted(cos, key=lambda c: (-cos[c], c))[:5]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_two_writers_never_share_a_version(spark, tmp_path):
    folder = str(tmp_path / "models")
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda _: artifacts.allocate_next_version(spark, folder), range(24)))
    assert len(set(taken)) == 24 and artifacts.resolve_latest_version(spark, folder) is None
    model = scoring.LogisticModel(scoring.Scaler((0.0,) * 9, (1.0,) * 9), (0.0,) * 13, 0.0)
    meta = scoring.Metadata("c", "now", "v1", 1, 1, 1, 0.5, {}, {})
    assert artifacts.publish(spark, folder, model, meta).endswith("/v25")
    artifacts.allocate_next_version(spark, folder)  # a writer that dies
    assert artifacts.resolve_latest_version(spark, folder).endswith("/v25")
    with pytest.raises(artifacts.ModelLoadError):
        artifacts.load_model_or_raise(spark, f"{folder}/v26")


def test_an_empty_held_out_split_is_refused(spark):
    decisions = "query_id long, chunk_id string, retrieval_score double, rank int, kept boolean, tokens int, threshold double, min_context int"
    evidence = spark.createDataFrame([(1, "a")], "query_id long, chunk_id string")
    rows = spark.createDataFrame([(1, "a", 0.9, 0, True, 10, 0.5, 2), (1, "b", 0.1, 5, False, 30, 0.5, 2)], decisions)
    got = {r.method: tuple(r)[1:] for r in metrics.held_out_eval(rows, evidence).collect()}
    assert got == {m: (1.0, 1.0, 0.75) for m in metrics.METHODS}
    with pytest.raises(Exception, match="held-out split is empty"):
        metrics.held_out_eval(rows.limit(0), evidence).collect()


def test_merged_sketches_stay_within_their_error(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).alias("day"), (F.xxhash64("id") % 1000).cast("double").alias("value"), (F.col("id") % 2).alias("key"))
    daily = metrics.latency_sketches(rows, "value", ["key", "day"])
    merged = metrics.merge_sketches(daily, ["key"])
    whole = metrics.latency_sketches(rows, "value", ["key"])
    values = {k: sorted(r.value for r in rows.filter(F.col("key") == k).collect()) for k in (0, 1)}
    for sketches in (merged, whole):
        for r in metrics.sketched_percentile(sketches, [0.1, 0.5, 0.99], ["key"]).collect():
            own = values[r.key]
            low, high = bisect.bisect_left(own, r.percentile_value) / len(own), bisect.bisect_right(own, r.percentile_value) / len(own)
            assert low - 2 * metrics.SKETCH_ERROR <= r.pct <= high + 2 * metrics.SKETCH_ERROR
    assert metrics.latency_sketches(rows.limit(0), "value").collect() == []


def test_why_a_question_was_not_pruned(spark):
    names = scoring.NUMERIC_FEATURES
    rows = [(q, f"c{i}", "d", i, i, 0.5, 10, "prose", *[None if (q, i, n) in {(2, 1, names[4]), (2, 2, names[3])} else 0.1 for n in names]) for q in (1, 2) for i in range(3)]
    kinds = "query_id long, chunk_id string, doc_id string, position int, rank int, retrieval_score double, tokens int, source_type string, "
    frame = spark.createDataFrame(rows, kinds + ", ".join(f"{n} double" for n in names))
    model = scoring.LogisticModel(scoring.Scaler((0.0,) * 9, (1.0,) * 9), (1.0,) * 13, 0.0)
    for own, version, want in ((model, "v3", {1: None, 2: f"feature {names[4]} is missing"}), (None, None, {1: "no model", 2: "no model"})):
        scored = scoring.predict_or_explain(frame, own, version).select(*scoring.PRUNED, "score_error", "model_version")
        decided = rules.explain(rules.apply_rules(rules.with_preset(scored)))
        got = {(r.query_id, r.disabled_reason, r.model_version, r.pruning_enabled) for r in decided.collect()}
        assert got == {(q, why, version, why is None) for q, why in want.items()}
        assert {r.query_id: r.disabled_reason for r in rules.summarise(decided).collect()} == want
