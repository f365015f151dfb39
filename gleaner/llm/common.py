"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow batches: rows per batch, so that a batch of very long texts stays in memory.
BATCH_ROWS = 500

# A membership table has at most so many rows of 64 bits, whatever was put into it.
MEMBER_WORDS = 1 << 16

# ASCII white space, the separator of words in all word-based operators.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves 2; a null id is never held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(rest == 2, F.lit(False))


def learnable(doc_id: Column, modulus: int) -> Column:
    """Whether a row may be learned from; rows with a null id may not."""
    return doc_id.isNotNull() & ~held_out(doc_id, modulus)


def _slot(columns: list[Column], words: int) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(*columns), F.lit(words * 64))
    word = F.floor(place / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return word, bit


def members(keys: DataFrame, *columns: str, words: int = MEMBER_WORDS) -> DataFrame:
    """A bit set of the keys' hashes: at most ``words`` rows, so it may be broadcast."""
    word, bit = _slot([F.col(c) for c in columns], words)
    return (
        keys.select(word.alias("_word"), bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_mask"))
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flag_members(df: DataFrame, bits: DataFrame, flag: str, *columns: str, words: int = MEMBER_WORDS) -> DataFrame:
    """Add ``flag``: false only if the key is surely not among the members."""
    word, bit = _slot([F.col(c) for c in columns], words)
    at, held = fresh(df, "_at"), fresh(df, "_held")
    bits = bits.select(F.col("_word").alias(at), F.col("_mask").alias(held))
    found = F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False))
    return df.withColumn(at, word).join(F.broadcast(bits), at, "left").withColumn(flag, found).drop(at, held)


def frequency_floor(counts: DataFrame, limit: int) -> int:
    """The smallest count such that at most ``limit`` rows of (.., n) have at least it.

    It comes from the histogram of counts, so no task sorts the rows.
    """
    steps = counts.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(limit + 1).collect()
    total, least = 0, 2**62
    for row in steps:
        total += row["rows"]
        if total > limit:
            break
        least = row["n"]
    return least


def trim(cache: dict, met: set, more: int, limit: int) -> None:
    """Before ``more`` entries come: of a full cache, keep what the batch at hand uses."""
    if len(cache) + more > limit:
        kept = {key: cache[key] for key in met if key in cache}
        cache.clear()
        cache.update(kept)


def worker_cache(owner: str, name: str = "") -> dict:
    """A dict that lives in the Python worker over the tasks of one owner.

    Another owner (a query, a stage, a model) takes the worker's only place, so that what
    earlier ones remembered is freed.  Functions that remember nothing call it as well.
    """
    module = sys.modules.setdefault("_gleaner_worker", types.ModuleType("_gleaner_worker"))
    if module.__dict__.get("owner") != owner:
        held = module.__dict__.get("caches")
        module.__dict__.update(owner=owner, caches={})
        if held:
            held.clear()
            give_back()
    return module.__dict__["caches"].setdefault(name, {})


def give_back() -> None:
    """Hand freed memory back to the system, which an idle worker would otherwise keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
