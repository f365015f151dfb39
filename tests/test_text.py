import pytest
from pyspark.sql import functions as F

from gleaner.config import MARKER_CLOSE as C
from gleaner.config import MARKER_OPEN as O
from gleaner.config import STOP_WORDS
from gleaner.functions import prompt, sections, text


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


T = None  # columns need a running session


@pytest.fixture(autouse=True)
def column(spark):
    global T
    T = F.col("t")


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 318


def test_two_tokenisers(spark):
    r = one(spark, "Étion de X_1 the", text.tokenize(T), text.retrieval_terms(T), text.content_tokens(T))
    assert r.c0 == ["tion", "de", "x_1", "the"]
    assert r.c1 == ["étion", "x_1"]
    assert r.c2 == ["tion", "x_1"]


def test_term_counts(spark):
    r = one(spark, "beta alpha beta gamma", text.term_counts(text.retrieval_terms(T)))
    assert [(x.term, x.tf) for x in r.c0] == [("alpha", 1), ("beta", 2), ("gamma", 1)]
    assert one(spark, "the of", text.term_counts(text.retrieval_terms(T))).c0 == []


def test_sentences_and_structured(spark):
    r = one(
        spark,
        " Got 50% of tsk_ab12. Really?  Yes 3.5! ",
        text.split_sentences(T),
        text.numbers(T),
        text.identifiers(T),
    )
    assert r.c0 == ["Got 50% of tsk_ab12.", "Really?", "Yes 3.5!"]
    assert sorted(r.c1) == ["3.5", "50"]
    assert r.c2 == ["tsk_ab12"]


def test_entities(spark):
    r = one(spark, "How does I reset password. via API and a/b :", text.entity_tokens(T))
    assert sorted(r.c0) == ["a/b", "api", "how", "password."]


def test_overlap_is_asymmetric(spark):
    a, b = F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("x"))
    r = one(spark, "", text.overlap_ratio(a, b), text.overlap_ratio(b, a), text.overlap_ratio(F.array().cast("array<string>"), a))
    assert (r.c0, r.c1, r.c2) == (0.5, 1.0, 0.0)


def test_bigrams_and_phrases(spark):
    r = one(spark, "reset user password", text.bigrams(text.content_tokens(T)), text.phrase_share(text.bigrams(text.content_tokens(T)), F.lit("Reset USER now")))
    assert r.c0 == ["reset user", "user password"]
    assert r.c1 == 0.5
    assert one(spark, "one", text.bigrams(text.content_tokens(T))).c0 == []


def test_banned_claims(spark):
    r = one(spark, "It is RISK-FREE and guarantees it", text.find_banned_claim(T))
    assert r.c0 == "guarantees"
    assert one(spark, "targets 40%", text.find_banned_claim(T)).c0 is None


def test_source_type(spark):
    st = sections.infer_source_type(T)
    assert one(spark, "|a|b|\n|c|d|\nx", st).c0 == "table"
    assert one(spark, "see\n    code\n    more", st).c0 == "code"
    assert one(spark, "see ```x```", st).c0 == "code"
    assert one(spark, "plain\ntext", st).c0 == "prose"


def test_sections(spark):
    s = sections.sections(T)
    r = one(spark, "pre\n# One\nbody a\n## Empty\n### Two \n#### deep\nx\n", s)
    assert [(x.heading, x.body) for x in r.c0] == [(None, "pre"), ("One", "body a"), ("Two", "#### deep\nx")]
    r = one(spark, "a\nb\n\n  \nc", s)
    assert [(x.heading, x.body) for x in r.c0] == [(None, "a\nb"), (None, "c")]
    assert one(spark, "", s).c0 == []


def test_marked_blocks(spark):
    value = f"q {O}one\n\ntwo{C} mid {O}  {C} end {O}open"
    r = one(spark, value, sections.marked_blocks(T), sections.strip_marked(T), sections.wrap_as_marked(T))
    assert [[c.body for c in b.chunks] for b in r.c0] == [["one", "two"], []]
    assert [value[b.start : b.end] for b in r.c0] == [f"{O}one\n\ntwo{C}", f"{O}  {C}"]
    assert r.c1 == f"q   mid   end {O}open"
    assert r.c2 == value
    assert one(spark, "x", sections.wrap_as_marked(T)).c0 == f"{O}\nx\n{C}"


def test_prompts(spark):
    chunk = lambda h: F.struct(F.lit("T").alias("title"), h.alias("heading"), F.lit("d::c0").alias("chunk_id"), F.lit("body").alias("text"))
    none = F.lit(None).cast("string")
    r = one(
        spark,
        "why?",
        prompt.build_prompt(T, F.array(chunk(F.lit("H")), chunk(none), chunk(F.lit("")))),
        prompt.build_marked_prompt(T, F.array(chunk(F.lit("H")), chunk(none), chunk(F.lit("")))),
        prompt.build_prompt(T, F.slice(F.array(chunk(none)), 1, 0)),
    )
    assert "[Source: T - H]\nbody\n\n[Source: T - d::c0]\nbody\n\n[Source: T - d::c0]\nbody" in r.c0
    assert r.c1.replace(f"{O}\n", "").replace(f"\n{C}", "") == r.c0
    assert r.c0.endswith("Question: why?\nAnswer:")
    assert "(no context retrieved)" in r.c2
