"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from gleaner.llm.common import documents, fresh
from gleaner.plans.sizing import materialise


TOKENIZER = "byte_bpe_50k.json"
# Workers still hold what earlier stages grew to, so packing remembers fewer pieces.
CACHED = 200_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the labelled ones; rejected ones go."""
    mark = fresh(docs, "_language")
    found = language_id.identify(docs, language_id.train(docs), out_col=mark)
    return found.filter(~F.col(f"{mark}.rejected")).drop(mark)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return exact_dedup.without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return exact_dedup.without(docs, simhash.near_duplicates(docs).filter("doc_id <> component_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier document has in the same run."""
    mark = fresh(docs, "_cleaned")
    found = substring_dedup.substring_dedup(docs, out_col=mark).withColumn("text", F.col(f"{mark}.text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(f"{mark}.removed") > 0, length).otherwise(F.col("n_chars")))
    return found.drop(mark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    vocabulary = Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")
    return packing.pack(packing.tokenised_pieces(docs, vocabulary, cached=CACHED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

# A fitted language model, fingerprints and token ids are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
