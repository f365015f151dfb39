from gleaner.operators import validation as v


def frames(spark, answers, context):
    a = spark.createDataFrame(answers, "answer_id long, query_text string, answer_text string")
    c = spark.createDataFrame(context, "answer_id long, chunk_id string, chunk_order int, text string")
    return a, c


def test_layers(spark):
    a, c = frames(
        spark,
        [
            (1, "rate limit requests", "The limit is 9999 requests. Rate windows reset hourly."),
            (2, "rate limit", "Bananas are yellow"),
            (3, "webhook", ""),
        ],
        [(i, "c1", 0, "The rate limit is 100 requests and windows reset hourly") for i in (1, 2, 3)],
    )
    got = {r.answer_id: r for r in v.layered_check(a, c).collect()}
    assert got[1].applicable and not got[1].passed and got[1].unsupported_numbers == ["9999"]
    assert got[1].covered and got[1].supported_sentences == 2 and got[1].grounded
    assert not got[2].applicable and got[2].passed and not got[2].covered and not got[2].grounded
    assert got[3].total_sentences == 0 and got[3].supported_ratio == 0.0 and not got[3].grounded


def test_first_chunk_wins_ties(spark):
    a, c = frames(spark, [(1, "q", "alpha beta.")], [(1, "z", 0, "alpha beta"), (1, "a", 1, "alpha beta gamma")])
    row = v.support(a, c).first()
    assert row.chunk_id == "z" and row.support_ratio == 1.0
    assert v.chunk_support(a, c).first().sentences == ["alpha beta."]


def test_counterfactual(spark):
    context = [(1, "c0", 0, "alpha beta"), (1, "c1", 1, "gamma delta"), (2, "c0", 0, "alpha beta"), (2, "c1", 1, "gamma delta")]
    pruned, full = frames(spark, [(1, "q", "alpha beta."), (2, "q", "alpha beta.")], context)
    restored, _ = frames(spark, [(1, "q", "alpha beta. gamma delta."), (2, "q", "alpha beta.")], context)
    retained = spark.createDataFrame([(1, "c0"), (2, "c0")], "answer_id long, chunk_id string")
    got = {r.answer_id: r for r in v.compare_counterfactual(pruned, restored, full, retained).collect()}
    assert got[1].improved and got[1].cited_restored == ["c1"]
    assert not got[2].improved and got[2].cited_restored == []
