"""Language-model scores of whole texts by a class-based bigram model.

Every word that occurs ``LEAST`` times is put into a class by exchange.  The most frequent
words and the endings of all others are exchanged first, one by one, on their bigram
counts; then the other words move in sweeps: Spark gathers how often each has which
classes beside it, and each takes the class that raises the likelihood most, given the
table of class bigrams.  Only rarer words stay with the class of their ending.

A text's probability is that of its class transitions and of each word in its class; a
rarer word is one among those with its ending.  The class of the word before is the
exchanged one for the ``FREQUENT`` most frequent words, which go to every task in a table
of bounded size, and that of the ending for others.  The classes and counts of words
outside that table meet the texts in a join, so the clustered vocabulary and all counts
grow with the corpus.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, frequency_floor, trim, worker_cache
from gleaner.plans.sizing import materialise

# Units of the first exchange: frequent words and endings (and one for other endings, and the end).
WORDS, ENDINGS = 1024, 254
CLASSES = 64
SWEEPS = 10
# Sweeps over all words of the table; rarer ones decide once, after the last.
WORD_SWEEPS = 2
# Words that occur less often stay with their ending.
LEAST = 5
ENDING_CHARS = 2
# Words that go to every task.
FREQUENT = 1 << 18
# Words whose neighbour counts are added up together, and shares of such counts that meet in one task.
BLOCK, MERGED = 256, 128
# Neighbours that a task holds before it counts them.
GATHERED = 1 << 22
# Distinct words that a task counts, and that a worker remembers.
COUNTED = 1 << 19
CACHE_WORDS = 300_000

END = b"\n"  # no word holds white space
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, without the end."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; each row counts one end, the word ``END``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
            if batch.num_rows:
                seen[END] += batch.num_rows
            if len(seen) > COUNTED:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: Column) -> Column:
    """Its last characters, in bytes."""
    return F.substring(word.cast("string"), -ENDING_CHARS, ENDING_CHARS).cast("binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; the last unit (the end) keeps class 0 for itself.

    Each unit in turn moves to the class that raises the likelihood of the class bigram
    model most, until a sweep moves none.
    """
    counts = bigrams.astype(float)
    n = len(counts)
    groups = max(1, min(classes - 1, n - 1))
    often = np.argsort(-(counts.sum(axis=0)[:-1]), kind="stable")
    own = np.zeros(n, np.int64)
    own[often] = 1 + np.arange(n - 1) % groups
    hot = np.eye(groups + 1)[own]
    after, before = counts @ hot, counts.T @ hot  # of each unit: counts by class of the neighbour
    table = hot.T @ counts @ hot
    for _ in range(sweeps):
        moved = 0
        for u in often:
            a, self_count = own[u], counts[u, u]
            row, col = after[u].copy(), before[u].copy()
            row[a] -= self_count
            col[a] -= self_count
            table[a] -= row
            table[:, a] -= col
            table[a, a] -= self_count
            gain_rows = _xlogx(table + row) - _xlogx(table)
            gain_cols = _xlogx(table.T + col) - _xlogx(table.T)
            corner = np.diag(table)
            here = gain_rows.sum(axis=1) - np.diag(gain_rows) + gain_cols.sum(axis=1) - np.diag(gain_cols)
            here += _xlogx(corner + row + col + self_count) - _xlogx(corner)
            for total, more in ((table.sum(axis=1), row.sum()), (table.sum(axis=0), col.sum())):
                here -= _xlogx(total + more + self_count) - _xlogx(total)
            here[0] = -np.inf
            b = int(here.argmax())
            if here[b] <= here[a] + 1e-9:
                b = a
            table[b] += row
            table[:, b] += col
            table[b, b] += self_count
            if b != a:
                moved += 1
                own[u] = b
                for side, lines in ((after, counts[:, u]), (before, counts[u])):
                    side[:, a] -= lines
                    side[:, b] += lines
        if not moved:
            break
    return own


@dataclass
class Model:
    """Words of the table have their place as code, the end ``len(words)``, endings follow.

    ``step``: log10 of a class behind a class, in base of ``classes`` by code; ``emit``:
    log10 of a code in its class; ``mass``: log10 of what a class counts in all.  A word
    without a class adds log10(count + 1) - ``among`` to the code of its ending.
    """

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray  # by code, up to the end
    endings: dict[bytes, int]
    classes: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    mass: np.ndarray
    among: np.ndarray


def _own_ending(word: bytes) -> bytes:
    if word.isascii():
        return word[-ENDING_CHARS:]
    return word.decode("utf-8", "replace")[-ENDING_CHARS:].encode("utf-8", "replace")


def _ship(spark: SparkSession, words: list[bytes], endings: dict[bytes, int]) -> Broadcast:
    """Sorted hashes of the table's words, their codes, and the endings."""
    from xxhash import xxh64_intdigest

    hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    return spark.sparkContext.broadcast((hashes[order], order.astype(np.int32), endings))


def _codes(line: list[bytes], cache: dict[bytes, int], table: tuple) -> np.ndarray:
    """The code of each word; one that is not in the table has that of its ending."""
    from xxhash import xxh64_intdigest

    hashes, codes, endings = table
    size = len(hashes)
    met = set(line)
    new = list(met.difference(cache))
    trim(cache, met, len(new), CACHE_WORDS)
    if new:
        hashed = np.array([xxh64_intdigest(w) for w in new], np.uint64)
        place = np.minimum(np.searchsorted(hashes, hashed), max(size - 1, 0))
        hit = hashes[place] == hashed if size else np.zeros(len(new), bool)
        found = codes[place].tolist() if size else [0] * len(new)
        cache.update(
            (w, c if h else size + 1 + endings.get(_own_ending(w), ENDINGS))
            for w, c, h in zip(new, found, hit.tolist(), strict=True)
        )
    cache[END] = size
    return np.fromiter(map(cache.__getitem__, line), np.int32, len(line))


def _coded(docs: DataFrame, text_col: str, table: Broadcast) -> DataFrame:
    """(codes, tail) of every text: packed codes of its words and the end, and its words that
    are not in the table with the codes beside them."""
    key = f"codes {uuid.uuid4().hex}"
    kinds = [("word", pa.binary()), ("before", pa.int32()), ("after", pa.int32())]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(key)
        for batch in batches:
            line, bounds = [], [0]
            for text in batch.column(0).to_pylist():
                line += tokens(text)
                line.append(END)
                bounds.append(len(line))
            if not line:
                continue
            codes = _codes(line, cache, table.value)
            at = np.flatnonzero(codes > len(table.value[0]))
            raw = codes.tobytes()
            ends = pa.array(np.searchsorted(at, bounds).astype(np.int32))
            # Every text ends with the end, so it also stands before each first word.
            parts = [pa.array([line[i] for i in at.tolist()], pa.binary()), pa.array(codes[at - 1]), pa.array(codes[(at + 1) % len(codes)])]
            tail = pa.StructArray.from_arrays(parts, names=[k for k, _ in kinds])
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.ListArray.from_arrays(ends, tail)],
                names=["codes", "tail"],
            )

    return docs.select(text_col).mapInArrow(code, "codes binary, tail array<struct<word: binary, before: int, after: int>>")


def _pairs(coded: DataFrame, groups: np.ndarray, n: int) -> np.ndarray:
    """How often group b stands behind group a; ``groups`` is by code."""
    shipped = coded.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            own = shipped.value[np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)]
            total += np.bincount(np.roll(own, 1) * n + own, minlength=n * n)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    found = coded.select("codes").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


def _gains(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one word behind class a, and before class b, gains by standing in each class."""
    smooth = table + 1
    behind = np.log(smooth / smooth.sum(axis=0))
    before = np.log(smooth.T / smooth.sum(axis=1))
    # The class of the end takes no word.
    behind[:, 0] = before[:, 0] = -1e9
    return behind, before


def _sweep(coded: DataFrame, classes: np.ndarray, table: np.ndarray, first: int, size: int) -> np.ndarray:
    """The class of each code in ``first`` .. ``size``: the best one beside its neighbours' classes."""
    n = len(table)
    width = 2 * n
    gains = np.concatenate(_gains(table))
    shipped = coded.sparkSession.sparkContext.broadcast(classes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        share = TaskContext.get().partitionId() // MERGED

        def rows() -> pa.RecordBatch:
            cells, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            block = cells // (BLOCK * width)
            blocks, at = np.unique(block, return_index=True)
            local = (cells - block * (BLOCK * width)).astype("<u2")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks.astype(np.int32)),
                    pa.array(np.full(len(blocks), share, np.int32)),
                    pa.array([x.tobytes() for x in np.split(local, at[1:])][: len(blocks)], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(times.astype("<i8"), at[1:])][: len(blocks)], pa.binary()),
                ],
                names=["block", "share", "cells", "times"],
            )

        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).astype(np.int64)
            own = shipped.value[codes]
            at = np.flatnonzero((codes >= first) & (codes < size))
            base = codes[at] * width
            held += [base + own[at - 1], base + n + own[(at + 1) % max(len(codes), 1)]]
            if sum(map(len, held)) > GATHERED:
                yield rows()
        yield rows()

    def added(frame: pd.DataFrame) -> np.ndarray:
        total = np.zeros(BLOCK * width, np.int64)
        for cells, times in zip(frame["cells"], frame["times"], strict=True):
            total[np.frombuffer(cells, "<u2")] += np.frombuffer(times, "<i8")
        return total

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = added(frame)
        cells = np.flatnonzero(total)
        return pd.DataFrame({"block": [key[0]], "cells": [cells.astype("<u2").tobytes()], "times": [total[cells].astype("<i8").tobytes()]})

    def decide(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = added(frame).reshape(BLOCK, width)
        rows = np.flatnonzero(total.any(axis=1))
        best = (total[rows].astype(float) @ gains).argmax(axis=1)
        return pd.DataFrame({"code": key[0] * BLOCK + rows, "cls": best})

    found = (
        coded.select("codes").mapInArrow(gather, "block int, share int, cells binary, times binary")
        .groupBy("block", "share").applyInPandas(merge, "block int, cells binary, times binary")
        .groupBy("block").applyInPandas(decide, "code int, cls int").toArrow()
    )
    out = classes.copy()
    out[found["code"].to_numpy()] = found["cls"].to_numpy()
    return out


def _tail(coded: DataFrame, classes: np.ndarray, table: np.ndarray, size: int, endings: dict[bytes, int]) -> DataFrame:
    """(word, n, cls, old, before) of every word outside the table.

    ``cls`` is null for words that stay with their ending, whose class is ``old``;
    ``before`` says how often which class stands before a word that has its own.
    """
    n = len(table)
    behind, ahead = _gains(table)
    shipped = coded.sparkSession.sparkContext.broadcast(classes)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            a, b = (shipped.value[flat.field(k).to_numpy(zero_copy_only=False)] for k in ("before", "after"))
            yield pa.RecordBatch.from_arrays([flat.field("word"), pa.array((a * n + b).astype(np.int32))], names=["word", "pair"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, near = batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(near.offsets.to_numpy())
            flat = near.flatten()
            pair, m = flat.field("pair").to_numpy(), flat.field("m").to_numpy()
            row = np.repeat(np.arange(len(times)), sizes)
            own = times >= LEAST
            kept = own[row]
            row, pair, m = row[kept], pair[kept], m[kept]
            cls, old = np.zeros(len(times), np.int32), np.zeros(len(times), np.int32)
            if len(row):
                rows, starts = np.unique(row, return_index=True)
                cls[rows] = np.add.reduceat(m[:, None] * (behind[pair // n] + ahead[pair % n]), starts).argmax(axis=1)
                words = batch.column(0).take(pa.array(rows)).to_pylist()
                old[rows] = shipped.value[[size + 1 + endings.get(_own_ending(w), ENDINGS) for w in words]]
            cell, at = np.unique(row * n + pair // n, return_inverse=True)
            before = pa.StructArray.from_arrays(
                [pa.array((cell % n).astype(np.int32)), pa.array(np.bincount(at, m, minlength=len(cell)).astype(np.int64))], names=["a", "m"]
            )
            bounds = np.concatenate([[0], np.cumsum(np.bincount(cell // n, minlength=len(times)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, mask=~own), pa.array(old, mask=~own), pa.ListArray.from_arrays(pa.array(bounds), before)],
                names=["word", "n", "cls", "old", "before"],
            )

    rows = coded.select("tail").mapInArrow(beside, "word binary, pair int").repartition("word")
    near = rows.groupBy("word", "pair").agg(F.count("*").alias("m")).groupBy("word").agg(
        F.sum("m").alias("n"), F.sort_array(F.collect_list(F.struct("pair", "m"))).alias("near")
    )
    return materialise(near.mapInArrow(decide, "word binary, n long, cls int, old int, before array<struct<a: int, m: long>>"))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table (word, n, cls, ..) of words outside its own.

    Null text counts as empty, so each row teaches at least its end; repeated rows count
    each time; an empty table gives a model that knows no word.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = materialise(word_counts(docs, text_col))
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = F.lit(bytearray(END))
    own = counted.filter(F.col("word") != end)
    least = max(frequency_floor(own, FREQUENT), LEAST)
    often = own.filter(F.col("n") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n_words = often["word"].to_pylist(), often["n"].to_numpy().astype(float)
    size, core = len(words), min(len(words), WORDS)
    # All words but the first units, by ending; those that will stay with it apart.
    rare = F.col("n") < LEAST
    groups = materialise(
        own.groupBy(ending(F.col("word")).alias("ending")).agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rare_n"),
            F.count(F.when(rare, 1)).alias("rare_v"),
        )
    )
    kept = groups.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()
    endings = {bytes(r["ending"]): i for i, r in enumerate(kept)}
    rest = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rare_n", "rare_v"))).first()
    ending_n, ending_v = np.zeros(ENDINGS + 1), np.zeros(ENDINGS + 1)
    for column, out in (("rare_n", ending_n), ("rare_v", ending_v)):
        out[: len(kept)] = [r[column] for r in kept]
        out[ENDINGS] = rest[column] - out.sum()

    coded = materialise(_coded(docs, text_col, _ship(spark, words, endings)))
    # The first exchange, of the core and the endings; the end is the last unit.
    stays = [core + endings.get(_own_ending(w), ENDINGS) for w in words[core:]]
    n_units = core + ENDINGS + 2
    units = np.array([*range(core), *stays, n_units - 1, *range(core, core + ENDINGS + 1)], np.int64)
    bigrams = _pairs(coded, units, n_units)
    used = np.flatnonzero((bigrams.sum(axis=0) > 0) | (np.arange(n_units) >= n_units - 2))
    of_unit = np.full(n_units, -1, np.int64)
    of_unit[used] = exchange(bigrams[np.ix_(used, used)])
    of_unit[of_unit < 0] = of_unit[-2]
    n = int(of_unit.max()) + 1
    classes = of_unit[units]
    hot = np.eye(n)[of_unit]
    table = hot.T @ bigrams @ hot
    for _ in range(WORD_SWEEPS):
        classes = _sweep(coded, classes, table, core, size)
        table = _pairs(coded, classes, n)
    tail = _tail(coded, classes, table, size, endings)
    placed = tail.filter(F.col("cls").isNotNull())
    moved = placed.select("cls", "old", F.explode("before").alias("x")).groupBy("cls", "old", "x.a").agg(F.sum("x.m").alias("m")).toArrow()
    cls, old, a, m = (moved[c].to_numpy() for c in ("cls", "old", "a", "m"))
    np.add.at(table, (a, cls), m)
    np.add.at(table, (a, old), -m)

    share = (table.sum(axis=0) + 1) / (table.sum() + n)
    kinds = np.maximum((table > 0).sum(axis=1), 1)
    # Witten-Bell: as much mass for the class shares as there are kinds of followers.
    follow = (table + kinds[:, None] * share) / (table.sum(axis=1) + kinds)[:, None]
    n_end = whole["n"] - n_words.sum() - (own.filter(F.col("n") < least).agg(F.sum("n")).first()[0] or 0)
    of_code = np.concatenate([n_words, [n_end], ending_n])
    mass = np.bincount(classes, of_code + 1, minlength=n)
    for r in placed.groupBy("cls").agg((F.sum("n") + F.count("*")).alias("m")).collect():
        mass[r["cls"]] += r["m"]
    mass = np.log10(np.maximum(mass, 1))
    emit = np.log10(of_code + 1) - mass[classes]
    model = Model(
        int(whole["n"]), int(whole["v"]), words, of_code[: size + 1], endings, classes, np.log10(follow), emit, mass, np.log10(ending_n + ending_v + 1)
    )
    return model, tail


def score(docs: DataFrame, model: Model, tail: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's; both
    include one end per text.  Null text counts as empty and has the end alone.  Equal
    texts get equal scores; rows that repeat an id are scored separately.  With nothing
    learned every probability is that of an unseen token.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = _ship(spark, model.words, model.endings)
    size, n = len(model.words), len(model.step)
    logs = np.concatenate([np.log10(model.counts + 1), np.zeros(ENDINGS + 1)])
    known = np.concatenate([model.counts > 0, np.zeros(ENDINGS + 1, bool)])
    # A word outside the table starts as an unseen one among those with its ending.
    alone = model.emit - np.concatenate([np.zeros(size + 1), model.among])
    shipped = spark.sparkContext.broadcast((model.classes, model.step, alone, logs, known))
    key = f"scores {uuid.uuid4().hex}"
    unseen = float(np.log10(model.tokens + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, step, alone, logs, known = shipped.value
        cache = worker_cache(key)
        for batch in batches:
            line, starts = [], []
            for text in batch.column(1).to_pylist():
                starts.append(len(line))
                line += tokens(text)
                line.append(END)
            if not line:
                continue
            codes = _codes(line, cache, table.value)
            own = classes[codes]
            before = np.roll(own, 1)
            value = step[before, own] + alone[codes]
            at = np.flatnonzero(codes > size)
            numbers: dict[bytes, int] = {}
            number = np.fromiter((numbers.setdefault(line[i], len(numbers)) for i in at.tolist()), np.int64, len(at))
            row = np.searchsorted(starts, at, "right") - 1
            # Equal words behind equal classes of one text are one entry.
            cell, first, times = np.unique((row * max(len(numbers), 1) + number) * n + before[at], return_index=True, return_counts=True)
            bounds = np.searchsorted(row[first], np.arange(len(starts) + 1)).astype(np.int32)
            words = list(numbers)
            rare = pa.StructArray.from_arrays(
                [
                    pa.array([words[i] for i in number[first].tolist()], pa.binary()),
                    pa.array((cell % n).astype(np.int32)),
                    pa.array(times),
                    pa.array(value[at[first]] * times),
                ],
                names=["word", "a", "times", "value"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff([*starts, len(line)])),
                    pa.array(np.add.reduceat(known[codes].astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs[codes], starts)),
                    pa.array(np.add.reduceat(value, starts)),
                    pa.ListArray.from_arrays(pa.array(bounds), rare),
                ],
                names=["doc_id", "n_tokens", "known", "logs", "value", "rare"],
            )

    entry = "array<struct<word: binary, a: int, times: long, value: double>>"
    schema = f"doc_id long, n_tokens long, known long, logs double, value double, rare {entry}"
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, schema)
    # Written, so that each row keeps its number.
    parts = materialise(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.*")

    def constant(numbers: np.ndarray) -> Column:
        return F.from_json(F.lit(json.dumps(numbers.ravel().tolist())), "array<double>")

    log = F.log10(F.col("n") + 1.0)
    in_class = F.get(constant(model.step), F.col("a") * n + F.col("cls")) - F.get(constant(model.mass), F.col("cls")) + log
    more = (
        rare.join(tail.select("word", "n", "cls"), "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("more"),
            F.sum(F.col("times") * log).alias("more_logs"),
            F.sum(F.when(F.col("cls").isNull(), F.col("times") * log).otherwise(F.col("times") * in_class - F.col("value"))).alias("more_value"),
        )
    )
    zero = F.lit(0.0)
    return parts.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        (F.col("value") + F.coalesce("more_value", zero)).alias("score"),
    )
