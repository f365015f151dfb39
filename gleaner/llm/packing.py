"""Best-fit packing of tokenised documents into sequences of a fixed length.

The number of pieces of each length is all that the plan needs.  A configuration
linear program over that histogram (at most ``capacity`` numbers, whatever the
input) is solved by multiplicative weights whose pricing problem is a knapsack; the
solution is rounded down and what it leaves is placed best-fit decreasing, again by
counts.  Pieces then find their place from their rank among the pieces of equal
length, so no sequence is ever assembled in one task.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, give_back, worker_cache
from gleaner.llm.pieces import CACHE_PIECES, LETTERS, encode_texts, merge_ranks
from gleaner.plans.sizing import materialise

CAPACITY = 1024
END_ID = 2
ROUNDS = 20
# Shares of the fractional cover that rounding tries.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
# A pattern joins a round's solution if it is worth this share of the best one.
NEAR_BEST = 0.98
# Rows of one length are ranked in slices of about so many.
SLICE_ROWS = 50_000
# Parts that the tokenizer encodes at once.
AT_ONCE = 1024


def _merger(ranks: dict[bytes, int]):
    """Ids of a single match, by its bytes."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHE_PIECES) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included.

    ``vocabulary`` is the text of a tokenizers JSON file; a worker remembers at most
    ``cached`` encoded pieces.  Null text counts as empty,
    so each row gives at least the piece that holds its end id.  Rows that repeat an
    id are separate documents; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast((vocabulary, merge_ranks(vocabulary)))
    key = f"ids {zlib.crc32(vocabulary.encode())}"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache, tools = worker_cache(key), worker_cache(key, "tools")
        if not tools:
            text, ranks = shipped.value
            tools["tokenizer"] = Tokenizer.from_str(text)
            tools["merger"] = _merger(ranks) if ranks else None
        tokenizer, merge = tools["tokenizer"], tools["merger"]

        def encode(parts: list[str]) -> list[bytes]:
            """Runs of letters are one match each and only merged; other parts take the tokenizer's pipeline."""
            letters = [merge is not None and LETTERS.fullmatch(p) is not None for p in parts]
            rest = tokenise([p for p, x in zip(parts, letters, strict=True) if not x])
            return [array("I", merge(p.encode()) if x else next(rest)).tobytes() for p, x in zip(parts, letters, strict=True)]

        def tokenise(parts: list[str]) -> Iterator[list[int]]:
            """A result of the tokenizer is many times as large as its ids, so few are held at once."""
            for i in range(0, len(parts), AT_ONCE):
                for found in tokenizer.encode_batch_fast(parts[i : i + AT_ONCE], add_special_tokens=False):
                    yield found.ids

        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(texts, cache, encode, cached), strict=True):
                ids += end
                n = len(ids) // 4
                stop = n % capacity or capacity
                start = piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth within each room, and the item taken there (-1: leave a token free)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if reach[room]:
            sums = best[room - lengths[: reach[room]]] + worth[: reach[room]]
            item = int(sums.argmax())
            if sums[item] > best[room]:
                best[room], taken[room] = sums[item], item
    return best, taken


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """A fractional cover: how often to use each pattern (lengths that share a sequence).

    Each round prices patterns by a knapsack over the current weights of the lengths and
    takes, for each length, the best pattern that holds it if that is near the optimum;
    lengths that were covered lose weight.
    """
    lengths = np.array(sorted(counts))
    demand = np.array([counts[x] for x in lengths], float)
    worth = lengths / capacity
    use: Counter[tuple[int, ...]] = Counter()
    for _ in range(rounds):
        best, taken = _knapsack(lengths, worth, capacity)
        value = worth + best[capacity - lengths]
        covered = np.zeros(len(lengths))
        for first in np.flatnonzero(value >= NEAR_BEST * value.max()):
            pattern, room = [first], capacity - lengths[first]
            while room > 0:
                if taken[room] < 0:
                    room -= 1
                else:
                    pattern.append(taken[room])
                    room -= lengths[taken[room]]
            held = Counter(pattern)
            times = min(demand[i] / n for i, n in held.items())
            for i, n in held.items():
                covered[i] += n * times / demand[i]
            use[tuple(sorted((int(lengths[i]) for i in pattern), reverse=True))] += times / rounds
        worth *= np.exp(-0.5 * covered / max(covered.max(), 1e-12))
        worth /= worth.max()
    return dict(use)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; together they hold every piece.

    The fractional cover is scaled to the demand, rounded down by several shares, and
    what is left goes best-fit decreasing; the share that needs fewest sequences wins.
    """
    cover = configurations(counts, capacity, rounds) if counts else {}
    held = sum(sum(p) * n for p, n in cover.items())
    scale = sum(x * n for x, n in counts.items()) / held if held else 0.0
    plans = [_rounded(counts, cover, share * scale, capacity) for share in SHARES]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _rounded(counts: dict[int, int], cover: dict[tuple[int, ...], float], scale: float, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    left = dict(counts)
    # By free room: sequences that may still take a piece.
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for pattern, n in sorted(cover.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
        need = Counter(pattern)
        times = min(int(n * scale), *(left[x] // k for x, k in need.items()))
        if times > 0:
            room.setdefault(capacity - sum(pattern), []).append((pattern, times))
            for x, k in need.items():
                left[x] -= k * times
    for x in sorted(left, reverse=True):
        while left[x] > 0:
            fit = min((r for r in room if r >= x and room[r]), default=None)
            if fit is None:
                many = max(1, capacity // x)
                full, odd = divmod(left[x], many)
                if full:
                    room.setdefault(capacity - many * x, []).append(((x,) * many, full))
                if odd:
                    room.setdefault(capacity - odd * x, []).append(((x,) * odd, 1))
                break
            pattern, times = room[fit].pop()
            taken = min(times, left[x])
            if times > taken:
                room[fit].append((pattern, times - taken))
            room.setdefault(fit - x, []).append(((*pattern, x), taken))
            left[x] -= taken
    return [x for kept in room.values() for x in kept]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces per sequence, first sequence, offset)."""
    rank: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for x, k in Counter(pattern).items():
            rows.setdefault(x, []).append((rank[x], k, sequence, offset))
            rank[x] += k * times
            offset += k * x
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces of one sequence follow each other without a gap from offset 0, and none is
    dropped; repeated rows are placed separately, and no rows give no sequences.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_sequences(counts, capacity, rounds)))
    slices = 1 + sum(counts.values()) // SLICE_ROWS
    keyed = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    before = (
        keyed.groupBy("length", "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n"))
        .drop("_n")
    )
    order = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(order)).join(before, ["length", "_slice"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("places")
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, many, base, shift = places.value[int(x)].T
                row = np.searchsorted(first, rank[at], "right") - 1
                step = rank[at] - first[row]
                sequence[at] = base[row] + step // many[row]
                offset[at] = shift[row] + step % many[row] * x
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    rank = (F.col("_before") + F.col("_rank") - 1).cast("long").alias("_rank")
    return ranked.select(*columns, rank).mapInArrow(place, PIECES + ", sequence_id long, offset long")
