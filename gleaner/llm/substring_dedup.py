"""Repeated passages, found as runs of consecutive sentences.

Every sentence starts one run and ends one: the shortest with enough sentences and
words.  Run hashes meet globally; where a run occurs again, the sentences it covers
are removed from all documents but the first.  Runs are as short as allowed, so a
longer passage is covered by the runs inside it.

Only hashes that occur in several documents come back for positions: a bit set of
bounded size lets a document test its own runs where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, flag_members, fresh, members, worker_cache
from gleaner.plans.sizing import materialise

MIN_SENTENCES = 2
MIN_WORDS = 30
# A sentence is also cut behind the word of smallest hash in every window of so many of its
# words, the last of equal ones.  Windows inside a passage pick the same words wherever it
# stands, so beyond its first and last WINDOW words at most it is cut alike everywhere, and a
# passage of MIN_WORDS + 2 * WINDOW - 1 words always holds a whole run.
WINDOW = 6
# Rows of the bit set of repeated hashes (64 bits each).
HASH_WORDS = 1 << 19

# White space as str.split() sees it.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)
# An odd base and its inverse modulo 2 ** 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each sentence (and the end of the text), its words, and its content hash.

    A sentence ends at a full stop before white space, at a line break, or at a cut.
    """
    from xxhash import xxh64_intdigest

    words = text.split()
    n = len(words)
    if not n:
        return np.array([len(text)], np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.concatenate([[True], np.isin(letters, _SPACES), [True]])
    begins = np.flatnonzero(blank[:-2] & ~blank[1:-1])
    last = np.flatnonzero(~blank[1:-1] & blank[2:])
    lines = np.cumsum(letters == ord("\n"))
    ends = np.isin(letters[last], _STOPS)
    ends[:-1] |= lines[begins[1:]] > lines[begins[:-1]]
    ends[-1] = True
    coded = "\n".join(words).encode("utf-8", "replace").split(b"\n")
    h = np.fromiter(map(xxh64_intdigest, coded), np.uint64, n)
    cut = ends.copy()
    if n >= WINDOW:
        within = np.concatenate([[0], np.cumsum(ends)])
        inside = np.flatnonzero(within[: n - WINDOW + 1] == within[WINDOW - 1 : n])
        smallest = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[inside, ::-1].argmin(axis=1)
        cut[inside + WINDOW - 1 - smallest] = True
    stop = np.flatnonzero(cut) + 1
    first = np.concatenate([[0], stop[:-1]])
    value = _spans(h, first, stop)
    value ^= value >> np.uint64(32)
    starts = np.append(begins[first], len(text))
    starts[0] = 0
    return starts, stop - first, value * _INVERSE


def _spans(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial in the hashes of each span, the same wherever the span stands."""
    n = len(hashes)
    powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)))
    # prefix[j] = sum of hash[k] * base ** k below j; a span is divided by base ** first.
    prefix = np.append(np.uint64(0), np.cumsum(hashes * powers[:n], dtype=np.uint64))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE)))
    return (prefix[stop] - prefix[first]) * inverse[first] + (stop - first).astype(np.uint64)


def runs(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, sentence behind the last, and hash of every run, in order of start.

    A run's hash is a polynomial in the hashes of its sentences, so that all runs of a
    text come from one prefix table.
    """
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), first + MIN_SENTENCES)
    last = np.arange(1, n + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1, last - MIN_SENTENCES)
    ahead, back = stop <= n, start >= 0
    both = np.unique(np.concatenate([first[ahead] * (n + 1) + stop[ahead], start[back] * (n + 1) + last[back]]))
    first, stop = both // (n + 1), both % (n + 1)
    value = _spans(hashes, first, stop)
    value ^= value >> np.uint64(32)
    return first, stop, value * _BASE


def _run_rows(docs: DataFrame) -> DataFrame:
    """(doc, key, h, start, stop, again): a row per run, ``again`` if the text had it before."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("runs")
        for batch in batches:
            owner, parts = [], [[], [], [], []]
            for k, text in enumerate(batch.column(2).to_pylist()):
                starts, sizes, hashes = sentences(text or "")
                first, stop, h = runs(sizes, hashes)
                again = np.ones(len(h), bool)
                again[np.unique(h, return_index=True)[1]] = False
                owner.append(np.full(len(h), k, np.int32))
                for part, values in zip(parts, (h.view(np.int64), starts[first], starts[stop], again), strict=True):
                    part.append(values)
            at = pa.array(np.concatenate([np.zeros(0, np.int32), *owner]))
            kinds = (np.int64, np.int32, np.int32, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    *(pa.array(np.concatenate([np.zeros(0, t), *p]).astype(t)) for t, p in zip(kinds, parts, strict=True)),
                ],
                names=["doc", "key", "h", "start", "stop", "again"],
            )

    return docs.mapInArrow(emit, "doc long, key long, h long, start int, stop int, again boolean")


def _cleaned(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    worker_cache("cleaned")  # frees what finding the runs left behind
    kept, spans = [], []
    for text, lost in zip(texts, gone, strict=True):
        merged: list[list[int]] = []
        for start, stop in sorted((s["start"], s["stop"]) for s in (lost if lost is not None else ())):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        at, parts = 0, []
        for start, stop in merged:
            parts.append(text[at:start])
            at = stop
        kept.append("".join([*parts, text[at:]]) if merged else text)
        spans.append([{"start": a, "stop": b} for a, b in merged])
    removed = [sum(s["stop"] - s["start"] for s in own) for own in spans]
    return pd.DataFrame({"text": kept, "removed": removed, "spans": spans})


CLEANED = "text string, removed long, spans array<struct<start: int, stop: int>>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "cleaned") -> DataFrame:
    """``docs`` with a struct ``out_col``: text, removed, spans (both in characters).

    The first occurrence, by id and then by place, of a repeated run stays; every
    sentence that a later occurrence covers goes, and the other sentences follow each
    other unchanged.  Null text stays null and empty text empty.  Null ids come last.
    Rows that repeat both id and text are one document and are cleaned alike.
    """
    bounded_batches(docs.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    own = docs.select(doc.alias("doc"), _row_key(id_col, text_col).alias("key"), text_col)
    # Within a text only the first place of a run can be the first of all.
    found = materialise(_run_rows(own))
    repeated = found.filter("not again").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    bits = materialise(members(repeated, "h", words=HASH_WORDS))
    maybe = flag_members(found.filter("not again"), bits, "_may", "h", words=HASH_WORDS)
    maybe = materialise(maybe.filter("_may").select("h", "doc", "key", "start", "stop"))
    first = materialise(
        maybe.groupBy("h")
        .agg(F.min(F.struct("doc", "key")).alias("origin"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("h", "origin")
    )
    later = maybe.join(first, "h").filter("doc <> origin.doc or key <> origin.key").select("key", "start", "stop")
    later = later.unionByName(found.filter("again").select("key", "start", "stop"))
    key, gone, may = (fresh(docs, c) for c in ("_key", "_spans", "_may"))
    lost = materialise(
        later.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    ).select(F.col("key").alias(key), F.col("spans").alias(gone))
    flagged = flag_members(docs.withColumn(key, _row_key(id_col, text_col)), members(lost, key), may, key)
    sure = flagged.filter(~F.col(may)).withColumn(gone, F.lit(None).cast("array<struct<start: int, stop: int>>"))
    rest = flagged.filter(may).join(lost, key, "left")
    clean = F.pandas_udf(_cleaned, CLEANED)
    return (
        sure.unionByName(rest)
        .withColumn(out_col, clean(F.col(text_col), F.col(gone)))
        .drop(key, gone, may)
    )


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))
