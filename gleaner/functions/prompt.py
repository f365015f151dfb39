"""Prompt text from a query and an ordered context array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import EMPTY_CONTEXT, MARKER_CLOSE, MARKER_OPEN, SYSTEM_INSTRUCTION


def context_block(chunks: Column) -> Column:
    """``chunks``: array of struct(title, heading, chunk_id, text) in order."""
    one = lambda c: F.concat(
        F.lit("[Source: "),
        c["title"],
        F.lit(" - "),
        F.coalesce(F.when(c["heading"] != "", c["heading"]), c["chunk_id"]),
        F.lit("]\n"),
        c["text"],
    )
    return F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, one), "\n\n")).otherwise(
        F.lit(EMPTY_CONTEXT)
    )


def _assemble(query: Column, context: Column) -> Column:
    return F.concat(
        F.lit(SYSTEM_INSTRUCTION + "\n\nContext:\n"),
        context,
        F.lit("\n\nQuestion: "),
        query,
        F.lit("\nAnswer:"),
    )


def build_prompt(query: Column, chunks: Column) -> Column:
    return _assemble(query, context_block(chunks))


def build_marked_prompt(
    query: Column, chunks: Column, marker_open: str = MARKER_OPEN, marker_close: str = MARKER_CLOSE
) -> Column:
    wrapped = F.concat(
        F.lit(marker_open + "\n"), context_block(chunks), F.lit("\n" + marker_close)
    )
    return _assemble(query, wrapped)
