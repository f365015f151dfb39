import random

from pyspark.sql import functions as F

from gleaner.operators import rules, updates
from gleaner.workload import queries


def test_sets_are_found_without_sorting_and_decided_like_single_runs(spark):
    rng = random.Random(4)
    weights = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(3)]
    runs = []
    for event in range(40):
        w = rng.randrange(3)
        runs.append((event, rng.choice([1, 2, 3, None]), rng.choice([0.4, 0.5]), rng.choice([1, 2]), rng.choice([40, 400]), weights[w], f"m{w}"))
    columns = "event_id long, query_id long, threshold double, min_context int, token_budget int, weights array<double>, model string"
    runs = spark.createDataFrame(runs, columns)
    pairs = [
        (q, f"d{i // 3}::c{i}", f"d{i // 3}", i, i, rng.randint(5, 60), [rng.uniform(-2, 2) for _ in range(3)], rng.choice([1, None]))
        for q in (1, 2) for i in range(8)
    ]
    pairs = spark.createDataFrame(
        pairs, "query_id long, chunk_id string, doc_id string, position int, rank int, tokens int, x array<double>, relevant int"
    )
    alone = runs.join(pairs, "query_id").withColumn("score", updates.score_with(F.col("weights"), F.col("x")))
    alone = rules.apply_rules(alone.drop("weights", "x"), ["event_id"]).filter("kept").groupBy("event_id").agg(
        F.count("*").alias("kept_chunks"), F.sum("tokens").alias("retained_tokens"),
        F.coalesce(F.sum("relevant"), F.lit(0)).alias("relevant_retained"),
    )
    once = runs.join(queries._decided_once(runs, pairs), list(queries.COMBINATION)).select(alone.columns)
    want, got = sorted(map(tuple, alone.collect())), sorted(map(tuple, once.collect()))
    assert got == want and want
    plan = queries._combinations(runs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
