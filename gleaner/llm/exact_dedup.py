"""Exact duplicates by progressive refinement.

Lengths are grouped first, then the prefix hashes of rows whose length is shared;
only rows that still have a partner are hashed in full.  Text never moves: the
three tests run where a row is read, against bit sets of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, flag_members, fresh, members
from gleaner.plans.sizing import materialise

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest id is kept.  Rows that repeat both id and
    text are all flagged alike; a null id loses against any other, and a group of
    null ids only keeps them all.  Null text equals empty text.  Other columns of
    ``docs`` are ignored.  ``text_sha256`` is null for rows without a partner unless
    ``all_digests`` is set.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text")
    ).select(
        "doc_id",
        "_text",
        F.octet_length("_text").alias("length"),
        F.xxhash64(F.substring("_text", 1, PREFIX_CHARS)).alias("prefix"),
    )
    marks = materialise(rows.select("length", "prefix"))
    by_length = members(_shared(marks, "length"), "length")
    partners = flag_members(marks, by_length, "_may", "length").filter("_may")
    by_prefix = members(_shared(partners, "length", "prefix"), "length", "prefix")
    hashed = materialise(
        flag_members(rows, by_prefix, "_may", "length", "prefix").select(
            "doc_id",
            "length",
            "_may",
            F.when(F.lit(all_digests) | F.col("_may"), F.sha2(F.col("_text").cast("binary"), 256)).alias("text_sha256"),
        )
    )
    # Written apart from the rows, so that a group holding most rows can be split in the join.
    groups = materialise(
        hashed.filter("_may")
        .groupBy("length", "text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    found = hashed.filter("_may").join(groups, ["length", "text_sha256"], "left")
    alone = hashed.filter("not _may").select(
        "*", F.lit(None).cast(groups.schema["keep_id"].dataType).alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.unionByName(alone).select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def _shared(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``dropped``, moving only rows that may be.

    Rows whose id is surely not dropped pass where they are read; the others meet the
    dropped ids in a join.  A null id is never dropped.
    """
    may, mark = fresh(docs, "_may"), fresh(docs, "_gone")
    gone = materialise(dropped.select(F.col(id_col).alias(mark)).distinct())
    flagged = flag_members(docs, members(gone, mark), may, id_col)
    sure = flagged.filter(~F.col(may)).drop(may)
    rest = flagged.filter(may).drop(may)
    return sure.unionByName(rest.join(gone, rest[id_col] == gone[mark], "left_anti"))
