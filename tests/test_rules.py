import random

from pyspark.sql import functions as F

from gleaner.operators import rules

SCHEMA = (
    "query_id long, chunk_id string, doc_id string, position int, rank int, score double, tokens int,"
    " threshold double, min_context int, token_budget int"
)


def run(spark, rows, policy, q=1):
    data = [(q, c, d, p, i, s, t, *policy) for i, (c, d, p, s, t) in enumerate(rows)]
    return {r.chunk_id: r for r in rules.apply_rules(spark.createDataFrame(data, SCHEMA)).collect()}


def test_boundary_buffer(spark):
    rows = [("a", "faq", 0, 0.9, 5), ("b", "faq", 1, 0.47, 5), ("c", "x", 2, 0.1, 5), ("d", "other", 0, 0.2, 5)]
    got = run(spark, rows, (0.5, 1, 10000))
    assert got["b"].kept and got["b"].borderline and got["b"].safety_override == "boundary_buffer"
    assert not got["d"].kept and got["d"].reasons == ["below_threshold"]


def test_neighbours(spark):
    rows = [("t", "faq", 3, 0.8, 5), ("n", "faq", 4, 0.05, 5), ("o", "other", 4, 0.05, 5)]
    got = run(spark, rows, (0.6, 1, 10000))
    assert got["n"].kept and got["n"].safety_override == "neighbor_preservation" and not got["o"].kept
    got = run(spark, rows, (0.6, 1, 1))
    assert got["t"].kept and not got["n"].kept and got["n"].reasons == ["budget_exceeded"]


def test_budget_conflict(spark):
    got = run(spark, [("huge", "d", 0, 0.9, 500)], (0.5, 1, 1))
    assert got["huge"].kept and got["huge"].budget_conflict
    assert got["huge"].reasons == ["top_ranked_result", "budget_conflict"]
    got = run(spark, [("a", "d", 0, 0.9, 10), ("huge", "e", 0, 0.9, 500), ("small", "f", 0, 0.9, 10)], (0.5, 1, 50))
    assert not got["huge"].kept and not got["huge"].budget_conflict and got["small"].kept


def test_fallback_for_the_whole_query(spark):
    got = run(spark, [("a", "d", 0, 0.9, 5), ("b", "e", 0, None, 5), ("c", "f", 0, 0.0, 5)], (0.5, 1, 5))
    assert all(r.kept and r.score is None and r.safety_override == "fallback_unpruned" for r in got.values())
    assert not any(r.pruning_enabled for r in got.values())


def test_presets(spark):
    df = spark.createDataFrame([(1, "balanced"), (2, "nope"), (3, "aggressive")], "query_id long, preset string")
    got = {r.query_id: (r.preset_name, r.threshold, r.min_context, r.token_budget) for r in rules.with_named_policy(df).collect()}
    assert got == {1: ("balanced", 0.5, 2, 2000), 2: ("balanced", 0.5, 2, 2000), 3: ("aggressive", 0.65, 1, 1200)}


def expected(rows, threshold, floor, budget):
    """The rules told again, one set at a time."""
    want = {}
    want[rows[0][0]] = True
    fires = [r for r in rows if r[3] >= threshold]
    for r in fires:
        want.setdefault(r[0], False)
    for r in rows:
        if threshold - 0.05 <= r[3] < threshold:
            want.setdefault(r[0], False)
    places = {(r[1], r[2]): r[0] for r in rows}
    for r in fires:
        for step in (-1, 1):
            near = places.get((r[1], r[2] + step))
            if near:
                want.setdefault(near, False)
    for r in rows:
        if len(want) < floor:
            want.setdefault(r[0], True)
    used, kept = 0, set()
    for r in rows:
        if r[0] in want and (want[r[0]] or used + r[4] <= budget):
            used += r[4]
            kept.add(r[0])
    return kept


def test_random_sets_against_brute_force(spark):
    rng = random.Random(5)
    data, want = [], {}
    for q in range(120):
        places = rng.sample([(d, p) for d in "xyz" for p in range(8)], 12)
        rows = [(f"c{i}", d, p, round(rng.random(), 3), rng.randint(1, 60)) for i, (d, p) in enumerate(places)]
        policy = (rng.choice([0.35, 0.5, 0.65]), rng.randint(1, 6), rng.choice([20, 90, 200]))
        want[q] = expected(rows, *policy)
        data += [(q, c, d, p, i, s, t, *policy) for i, (c, d, p, s, t) in enumerate(rows)]
    decided = rules.apply_rules(spark.createDataFrame(data, SCHEMA).repartition(5))
    got = {q: set() for q in want}
    for r in decided.filter("kept").collect():
        got[r.query_id].add(r.chunk_id)
    assert got == want
    totals = rules.summarise(decided).agg(F.sum("tokens_saved").alias("s"), F.min("pct_tokens_saved").alias("p")).first()
    assert totals.s > 0 and totals.p >= 0
