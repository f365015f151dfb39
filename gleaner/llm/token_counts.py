"""Token counts of whole texts by two map-side lookups.

The lengths of the corpus' most frequent pieces go to every task as one compact table
of sorted hashes; other pieces are encoded by the tokenizer and remembered by the
worker.  No piece is shuffled: which ones are frequent comes from a bounded summary
of each task.  The tables only save work, so the counts do not depend on them.

Cutting at ASCII white space is exact for tokenizers that drop white space and whose
matches never span it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, trim, worker_cache

# Pieces in the broadcast table, and in the summary of one task.
FREQUENT = 1 << 16
SUMMARY = 1 << 14
# Distinct pieces a task counts before it forgets those seen least.
COUNTED = 1 << 19
CACHE_PIECES = 600_000
LIMIT = 2048

# A word and one mark behind it are separate matches.  The letters stay letters when
# lower-cased, which the dotted capital I does not.
_MARKED = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,]")


def frequent_pieces(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """At most ``FREQUENT`` pieces, the most frequent of what the tasks report."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((text or "").encode("utf-8", "replace").split())
            if len(seen) > COUNTED:
                seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"]
        )

    found = (
        docs.select(text_col)
        .mapInArrow(count, "piece binary, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT)
    )
    return [bytes(row["piece"]) for row in found.select("piece").collect()]


def _lengths(tokenizer, pieces: list[bytes], cache: dict[bytes, int]) -> None:
    """Put the number of tokens of each piece into ``cache``."""
    texts = [piece.decode("utf-8", "replace") for piece in pieces]
    bodies = [text[:-1] if _MARKED.fullmatch(text) else text for text in texts]
    fresh = list({body: None for body in bodies if body.encode("utf-8", "replace") not in cache})
    sizes = map(len, tokenizer.encode_batch_fast(fresh, add_special_tokens=False))
    cache.update(zip((body.encode("utf-8", "replace") for body in fresh), sizes, strict=True))
    marks = {mark: len(tokenizer.encode(mark, add_special_tokens=False)) for mark in (".", ",")}
    for piece, text, body in zip(pieces, texts, bodies, strict=True):
        if body is not text:
            cache[piece] = cache[body.encode("utf-8", "replace")] + marks[text[-1]]


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "counts", limit: int = LIMIT) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the text of a tokenizers JSON file.  Null text counts as empty:
    no bytes, no tokens.  Texts of any length are counted whole; equal texts get equal
    counts, and no rows give no rows.
    """
    from tokenizers import Tokenizer
    from xxhash import xxh64_intdigest

    spark = docs.sparkSession
    bounded_batches(spark)
    known: dict[bytes, int] = {}
    pieces = frequent_pieces(docs, text_col)
    _lengths(Tokenizer.from_str(vocabulary), pieces, known)
    hashes = np.array([xxh64_intdigest(p) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    shipped = spark.sparkContext.broadcast(
        (vocabulary, hashes[order], np.array([known[p] for p in pieces], np.uint32)[order])
    )
    key = zlib.crc32(vocabulary.encode())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text_of_vocabulary, table, sizes = shipped.value
        tokenizer = Tokenizer.from_str(text_of_vocabulary)
        cache = worker_cache(f"lengths {key}")
        for texts in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            cut = [t.split() for t in raw]
            met = list(set().union(*cut))
            trim(cache, set(met), len(met), CACHE_PIECES)
            hashed = np.array([xxh64_intdigest(p) for p in met], np.uint64)
            if len(table) and met:
                at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
                hit = table[at] == hashed
                found = sizes[at].tolist()
            else:
                hit, found = np.zeros(len(met), bool), [0] * len(met)
            _lengths(tokenizer, [p for p, h in zip(met, hit, strict=True) if not h and p not in cache], cache)
            length = {p: n if h else cache[p] for p, h, n in zip(met, hit, found, strict=True)}
            tokens = np.array([sum(map(length.__getitem__, own)) for own in cut], np.int64)
            yield pd.DataFrame(
                {"n_bytes": np.array([len(t) for t in raw], np.int64), "n_tokens": tokens, "over_limit": tokens > limit}
            )

    schema = "n_bytes long, n_tokens long, over_limit boolean"
    return docs.withColumn(out_col, F.pandas_udf(count, schema)(F.col(text_col)))
