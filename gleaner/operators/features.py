"""Relevance features of (query, chunk) pairs within a query's ranked set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import FEATURE_VERSION, NUMERIC_FEATURES
from gleaner.functions.text import (
    bigrams,
    content_tokens,
    entity_tokens,
    overlap_ratio,
    phrase_share,
    tokenize,
)

FEATURE_COLUMNS = (*NUMERIC_FEATURES, "source_type", "feature_version")


def extract_features(pairs: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``pairs``: keys, query_text, chunk_id, doc_id, position, text, doc_title,
    heading, source_type, score, rank.

    Text columns are consumed here and not returned.  The first window clusters
    by ``keys``; the neighbour window (keys, doc_id) reuses that exchange.
    """
    query_words = tokenize(F.col("query_text"))
    measured = pairs.select(
        *keys,
        "chunk_id",
        "doc_id",
        "position",
        "rank",
        "score",
        "source_type",
        F.size(tokenize(F.col("text"))).alias("_len"),
        overlap_ratio(query_words, tokenize(F.col("text"))).alias("query_token_overlap_ratio"),
        phrase_share(bigrams(content_tokens(F.col("query_text"))), F.col("text")).alias(
            "exact_phrase_overlap"
        ),
        overlap_ratio(
            query_words,
            tokenize(F.concat("doc_title", F.lit(" "), F.coalesce("heading", F.lit("")))),
        ).alias("title_or_heading_overlap"),
        overlap_ratio(entity_tokens(F.col("query_text")), entity_tokens(F.col("text"))).alias(
            "entity_overlap"
        ),
    )
    whole = Window.partitionBy(*keys)
    beside = Window.partitionBy(*keys, "doc_id").orderBy("position")
    ahead, behind = beside.rangeBetween(1, 1), beside.rangeBetween(-1, -1)
    longest = F.max("_len").over(whole)
    around = F.coalesce(F.sum("score").over(behind), F.lit(0.0)) + F.coalesce(
        F.sum("score").over(ahead), F.lit(0.0)
    )
    n_around = F.count("score").over(behind) + F.count("score").over(ahead)
    return measured.select(
        *keys,
        "chunk_id",
        "doc_id",
        "position",
        "rank",
        "score",
        F.col("score").alias("tfidf_similarity"),
        F.col("rank").alias("retrieval_rank"),
        (F.max("score").over(whole) - F.col("score")).alias("score_margin"),
        "query_token_overlap_ratio",
        "exact_phrase_overlap",
        "title_or_heading_overlap",
        "entity_overlap",
        F.when(longest > 0, F.col("_len") / longest).otherwise(F.lit(0.0)).alias(
            "normalized_chunk_length"
        ),
        F.when(n_around > 0, around / n_around).otherwise(F.lit(0.0)).alias("neighbor_relevance"),
        "source_type",
        F.lit(FEATURE_VERSION).alias("feature_version"),
    )
