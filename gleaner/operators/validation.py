"""Checks of an answer against the chunks that were kept for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import (
    ANSWER_GROUNDED_THRESHOLD,
    COVERAGE_THRESHOLD,
    SENTENCE_SUPPORT_THRESHOLD,
)
from gleaner.functions.text import (
    content_tokens,
    identifiers,
    numbers,
    overlap_ratio,
    split_sentences,
)


def _missing(answers: DataFrame, context: DataFrame, tokens, name: str) -> DataFrame:
    """Tokens an answer states that none of its context chunks holds."""
    said = answers.select("answer_id", F.explode_outer(tokens(F.col("answer_text"))).alias("t"))
    held = context.select("answer_id", F.explode_outer(tokens(F.col("text"))).alias("t")).distinct()
    lost = said.filter(F.col("t").isNotNull()).join(held, ["answer_id", "t"], "left_anti")
    return lost.groupBy("answer_id").agg(F.array_sort(F.collect_set("t")).alias(name))


def check_structured(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Numbers and identifiers of the answer must occur in its context.

    ``answers``: answer_id, answer_text; ``context``: answer_id, chunk_id, text.
    """
    none = F.expr("cast(array() as array<string>)")
    stated = F.size(numbers(F.col("answer_text"))) + F.size(identifiers(F.col("answer_text")))
    return (
        answers.select("answer_id", (stated > 0).alias("applicable"))
        .join(_missing(answers, context, numbers, "unsupported_numbers"), "answer_id", "left")
        .join(_missing(answers, context, identifiers, "unsupported_identifiers"), "answer_id", "left")
        .select(
            "answer_id",
            "applicable",
            (F.col("unsupported_numbers").isNull() & F.col("unsupported_identifiers").isNull()).alias("passed"),
            F.coalesce("unsupported_numbers", none).alias("unsupported_numbers"),
            F.coalesce("unsupported_identifiers", none).alias("unsupported_identifiers"),
        )
    )


def covered_ratio(query: Column, answer: Column) -> Column:
    return overlap_ratio(content_tokens(query), content_tokens(answer))


def check_coverage(answers: DataFrame) -> DataFrame:
    """``answers``: answer_id, query_text, answer_text."""
    ratio = covered_ratio(F.col("query_text"), F.col("answer_text"))
    return answers.select("answer_id", ratio.alias("covered_ratio")).withColumn(
        "covered", F.col("covered_ratio") >= COVERAGE_THRESHOLD
    )


def support(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Best chunk per sentence: answer_id, sentence_no, sentence, chunk_id,
    support_ratio, supported.

    ``context`` carries ``chunk_order``; the first chunk wins a tie.  Sentences
    meet chunks only over shared words, keyed by answer.
    """
    sentences = answers.select(
        "answer_id", F.posexplode_outer(split_sentences(F.col("answer_text"))).alias("sentence_no", "sentence")
    ).filter(F.col("sentence_no").isNotNull())
    words = sentences.select(
        "answer_id",
        "sentence_no",
        F.array_distinct(content_tokens(F.col("sentence"))).alias("_w"),
    )
    exploded = words.select(
        "answer_id", "sentence_no", F.size("_w").alias("_n"), F.explode_outer("_w").alias("word")
    )
    held = context.select(
        "answer_id",
        "chunk_id",
        "chunk_order",
        F.explode_outer(F.array_distinct(content_tokens(F.col("text")))).alias("word"),
    )
    ratios = (
        exploded.join(held, ["answer_id", "word"])
        .groupBy("answer_id", "sentence_no", "chunk_id", "chunk_order")
        .agg((F.count("*") / F.first("_n")).alias("support_ratio"))
    )
    best = Window.partitionBy("answer_id", "sentence_no").orderBy(
        F.col("support_ratio").desc(), "chunk_order", "chunk_id"
    )
    top = ratios.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1)
    return sentences.join(
        top.select("answer_id", "sentence_no", "chunk_id", "support_ratio"),
        ["answer_id", "sentence_no"],
        "left",
    ).select(
        "answer_id",
        "sentence_no",
        "sentence",
        "chunk_id",
        F.coalesce("support_ratio", F.lit(0.0)).alias("support_ratio"),
        F.coalesce(F.col("support_ratio") >= SENTENCE_SUPPORT_THRESHOLD, F.lit(False)).alias("supported"),
    )


def ground_answer(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Sentence counts, supported ratio and verdict per answer."""
    counts = support(answers, context).groupBy("answer_id").agg(
        F.count("*").alias("total_sentences"),
        F.count(F.when(F.col("supported"), 1)).alias("supported_sentences"),
    )
    total = F.coalesce("total_sentences", F.lit(0))
    good = F.coalesce("supported_sentences", F.lit(0))
    ratio = F.when(total > 0, good / total).otherwise(F.lit(0.0))
    return answers.select("answer_id").join(counts, "answer_id", "left").select(
        "answer_id",
        total.alias("total_sentences"),
        good.alias("supported_sentences"),
        ratio.alias("supported_ratio"),
        ((total > 0) & (ratio >= ANSWER_GROUNDED_THRESHOLD)).alias("grounded"),
    )


def chunk_support(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Which sentences each chunk supports: answer_id, chunk_id, sentences."""
    used = support(answers, context).filter("supported")
    return used.groupBy("answer_id", "chunk_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda s: s["sentence"]
        ).alias("sentences")
    )


def layered_check(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Structured, coverage and grounding layers side by side."""
    return (
        check_structured(answers, context)
        .join(check_coverage(answers), "answer_id")
        .join(ground_answer(answers, context), "answer_id")
    )


def compare_counterfactual(
    pruned_answers: DataFrame,
    restored_answers: DataFrame,
    full_context: DataFrame,
    retained: DataFrame,
) -> DataFrame:
    """Did the full-context retry help by citing a chunk that had been dropped?

    ``retained``: answer_id, chunk_id of what pruning kept.  Improved means at
    least as well grounded and citing something not retained.
    """
    kept_context = full_context.join(
        retained.select("answer_id", "chunk_id"), ["answer_id", "chunk_id"], "left_semi"
    )
    before = ground_answer(pruned_answers, kept_context).select(
        "answer_id", F.col("supported_ratio").alias("pruned_grounded_ratio")
    )
    after = ground_answer(restored_answers, full_context).select(
        "answer_id", F.col("supported_ratio").alias("restored_grounded_ratio")
    )
    cited = (
        support(restored_answers, full_context)
        .filter("supported")
        .select("answer_id", "chunk_id")
        .distinct()
        .join(retained.select("answer_id", "chunk_id"), ["answer_id", "chunk_id"], "left_anti")
        .groupBy("answer_id")
        .agg(F.array_sort(F.collect_list("chunk_id")).alias("cited_restored"))
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        before.join(after, "answer_id")
        .join(cited, "answer_id", "left")
        .select(
            "answer_id",
            (
                (F.col("restored_grounded_ratio") >= F.col("pruned_grounded_ratio"))
                & F.col("cited_restored").isNotNull()
            ).alias("improved"),
            "pruned_grounded_ratio",
            "restored_grounded_ratio",
            F.coalesce("cited_restored", none).alias("cited_restored"),
        )
    )
