"""Byte-level BPE as a fold of ranked merges, in Spark's higher-order functions."""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gleaner.llm.common import BATCH_ROWS, bounded_batches, frequency_floor, fresh, give_back, worker_cache
from gleaner.plans.sizing import materialise

# Words whose ids go to every task.
FREQUENT = 1 << 20
# Longer words are merged in the worker.
LONG = 256
# Bits of the place of a part: 0 before a word, then from 1 the byte where it starts.
PLACE = 9
# Numbers from here on stand for a document's rare words until these are folded.
RARE = 1 << 31
# Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
# Begins a piece that has no space before it.
BARE = "\0"
# White space, and characters taken for it, in Arrow's patterns.
_WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# A run of white space that forbids cutting a text at its spaces, or at its ends of lines.
_RUN = f"{_WHITE} {_WHITE}|\\x00"
_WIDE_END = rf"{_WHITE}\n|\n{_WHITE}"
# Letters, and letters with one mark: one match and two, in patterns that keep words whole.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$"
_MARKED = "^[A-Za-zÀ-ÖØ-öø-ɏ]+[.,]$"


def parse_ranks(text: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(n) for a, n in (line.split() for line in text.splitlines() if line.strip())}


class RankTable(NamedTuple):
    """The ranks as constants of an expression.

    ``pairs``: pairs of ids whose bytes together have a rank, those ranks in ``ranks``, and
    in ``shifts``, by the pair's remainder, how far it stands from its place.  They are flat
    arrays because every task reads the constants: 65,536 small maps took it seconds.
    ``firsts``: what a byte's part is at first, by the byte and the next one.
    ``whole``: words that have a rank but are not merged into it, by hex in buckets.
    Ids take ``width`` bits; ids above ``largest`` stand for bytes without a rank.
    """

    pairs: Column
    ranks: Column
    shifts: Column
    sizes: tuple[int, int]
    firsts: Column
    whole: Column | None
    buckets: int
    width: int
    largest: int


def placed(pairs: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Pairs and ranks in an array of places, -1 where none is, and the shifts.

    Pairs with one remainder move on together until all their places are free.
    """
    groups = len(pairs) // 3 | 1
    size = 2 * len(pairs) + 2
    while True:
        size += 1 + size % 2  # odd
        own: list[list[int]] = [[] for _ in range(groups)]
        for pair in pairs:
            own[pair % groups].append(pair)
        held, shifts = [-1] * size, [0] * groups
        for group in sorted(range(groups), key=lambda g: -len(own[g])):
            at = [pair % size for pair in own[group]]
            if len(set(at)) < len(at):
                break
            shift = next((d for d in range(size) if all(held[(x + d) % size] < 0 for x in at)), None)
            if shift is None:
                break
            shifts[group] = shift
            for x, pair in zip(at, own[group], strict=True):
                held[(x + shift) % size] = pair
        else:
            return held, [pairs.get(pair, -1) for pair in held], shifts


def rank_literal(ranks: dict[bytes, int]) -> RankTable:
    from xxhash import xxh64_intdigest

    largest = max(ranks.values(), default=0)
    full = {bytes([b]): largest + 1 + b for b in range(256)} | ranks
    width = (largest + 258).bit_length()
    never, shift = (1 << width) - 1, width + PLACE
    pairs: dict[int, int] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = full.get(token[:i]), full.get(token[i:])
            if left is not None and right is not None:
                pairs[left << width | right] = rank
    single = [bytes([b]) for b in range(256)]
    firsts = [(ranks.get(a + b, never) if b else never) << shift | full[a] for a in single for b in [*single, b""]]
    unmerged = {t: n for t, n in ranks.items() if merge_long(t, full) != [n]}
    buckets = max(1, len(unmerged))
    whole: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in unmerged.items():
        key = token.hex().upper()
        whole[xxh64_intdigest(key, 42) % (1 << 32) % buckets][key] = rank
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)
    held, values, shifts = placed(pairs)
    return RankTable(
        *(constant(values, "array<bigint>") for values in (held, values, shifts)),
        (len(held), len(shifts)),
        constant(firsts, "array<bigint>"),
        constant(whole, "array<map<string,int>>") if unmerged else None,
        buckets,
        width,
        largest if len(full) > len(ranks) else 1 << width,
    )


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once.

    It is the end of an empty fold: an element of an array of one would ask for the
    type of the whole body whenever it is evaluated.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def merged_ranks(word: Column, table: RankTable) -> Column:
    """Ids (array of int) of a binary word of at most 256 bytes: the lowest-ranked pair merges until none is left.

    The state is an array of parts.  A part is one number: from its highest bits on, the
    rank of its bytes and the next part's together, the place where it starts, its id.  So
    the smallest part is the leftmost of lowest rank.  One step merges it with the next one
    and looks up its two new neighbours.
    """
    merged = _fold(word, table, [])
    if table.whole is not None:
        bucket = lambda key: F.xxhash64(key).bitwiseAND(F.lit((1 << 32) - 1)) % table.buckets
        rank = _bind(F.hex(word), lambda key: F.try_element_at(F.get(table.whole, bucket(key).cast("int")), key))
        merged = _bind(rank, lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(merged))
    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(merged)


def _fold(word: Column, table: RankTable, bound: list[Column]) -> Column:
    constants = table.pairs, table.ranks, table.shifts, table.firsts
    if len(bound) < len(constants):  # named once, so that a plan holds each of them once
        return _bind(constants[len(bound)], lambda c: _fold(word, table, [*bound, c]))
    pairs, ranks, shifts, firsts = bound
    width = table.width
    shift = width + PLACE
    never = (1 << width) - 1
    size, groups = table.sizes
    number = lambda n: F.lit(n).cast("long")
    own = lambda part: part.bitwiseAND(number(never))

    def with_rank(part: Column, left: Column, right: Column) -> Column:
        """``part`` with the rank of the ids ``left`` and ``right`` together."""

        def found(pair: Column) -> Column:
            place = (pair % size + F.get(shifts, (pair % groups).cast("int"))) % size
            return _bind(place.cast("int"), lambda i: F.when(F.get(pairs, i) == pair, F.get(ranks, i)).otherwise(number(never)))

        return F.shiftleft(_bind(F.shiftleft(left, width).bitwiseOR(right), found), shift).bitwiseOR(part)

    def merge(parts: Column, least: Column) -> Column:
        def at(i: Column) -> Column:
            id_ = F.shiftright(least, shift)
            before = F.get(parts, i - 1)
            new = F.array(
                with_rank(before.bitwiseAND(number((1 << shift) - 1)), own(before), id_),
                with_rank(least.bitwiseAND(number((1 << shift) - (1 << width))).bitwiseOR(id_), id_, own(F.get(parts, i + 2))),
            )
            return F.concat(F.slice(parts, F.lit(1), i - 1), new, F.slice(parts, i + 3, F.size(parts)))

        # Not array_position, which leaves its loop by an exception.
        place = lambda part: F.shiftright(part, width).bitwiseAND(number((1 << PLACE) - 1))
        return _bind(place(least), lambda here: _bind(F.size(F.filter(parts, lambda p: place(p) < here)), at))

    def step(parts: Column, _: Column) -> Column:
        return _bind(F.array_min(parts), lambda x: F.when(x < number(never << shift), merge(parts, x)).otherwise(parts))

    # A part before the first and one behind the last, which have no rank with any other.
    outer = lambda place: F.array(number(never << shift | place << width | never))
    text = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.ascii(c))
    first = lambda b: F.transform(
        b, lambda x, i: F.get(firsts, x * 257 + F.coalesce(F.get(b, i + 1), F.lit(256))) + (i + 1).cast("long") * number(1 << width)
    )
    start = F.concat(outer(0), _bind(text, first), outer(LONG + 1))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step)
    ids = _bind(folded, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: own(x).cast("int")))
    return F.transform(ids, lambda x: F.when(x <= table.largest, x)) if table.largest < never else ids


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def laid_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the items of segments, one segment behind the other."""
    ends = np.cumsum(sizes)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places))
    return places


def ends_of(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds counted in the items of the segments, from bounds counted in segments."""
    return np.concatenate([[0], np.cumsum(sizes)])[bounds]


def bytes_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that share a buffer: ``bounds`` are counted in items of ``values``."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int64))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values)])
    return whole.cast(pa.binary())


def cut_pieces(texts: pa.Array, lines: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the numbers of those that make up the texts, and the bounds of each text.

    A piece stands behind a space, unless it begins with ``BARE``.  The matches of the
    pieces together are those of the text, as ``pieces`` says.  With ``lines`` texts are
    also cut before an end of line that stands between visible characters.
    """
    texts = texts.cast(pa.string()).fill_null("")
    odd = pc.match_substring_regex(texts, _RUN)
    plain = pc.if_else(odd, "", texts)
    if lines:
        ended = pc.replace_substring(plain, "\n", f" {BARE}\n")
        plain = pc.if_else(pc.match_substring_regex(plain, _WIDE_END), plain, ended)
    cut = pc.split_pattern(pc.binary_join_element_wise(BARE, plain, ""), " ")
    coded = cut.flatten().dictionary_encode()
    pieces, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(at):
        numbers = numbers.copy()
        numbers[bounds[at]] = len(pieces) + np.arange(len(at))
        pieces = pa.concat_arrays([pieces, pc.binary_join_element_wise(BARE, texts.take(pa.array(at)), "")])
    return pieces, numbers, bounds


def piece_words(pieces: pa.Array, found: Callable[[str], list[str]], plain: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct matches in the pieces, the numbers of those of each piece, and how many each has."""
    none = np.zeros(len(pieces), bool)
    single = pc.match_substring_regex(pieces, _LETTERS).to_numpy(zero_copy_only=False) if plain else none
    marked = pc.match_substring_regex(pieces, _MARKED).to_numpy(zero_copy_only=False) if plain else none
    other = np.flatnonzero(~(single | marked))
    two = pieces.filter(pa.array(marked))
    lists = [found(p[1:] if p.startswith(BARE) else " " + p) for p in pieces.take(pa.array(other)).to_pylist()]
    spaced = lambda words: pc.binary_join_element_wise(" ", words, "")
    runs = [
        spaced(pieces.filter(pa.array(single))),
        spaced(pc.utf8_slice_codeunits(two, 0, -1)),
        pc.utf8_slice_codeunits(two, -1),
        pa.array([w for own in lists for w in own], pa.string()),
    ]
    coded = pa.concat_arrays(runs).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    sizes = single + 2 * marked.astype(np.int64)
    sizes[other] = [len(own) for own in lists]
    starts = np.cumsum(sizes) - sizes
    first, second, third = np.cumsum([len(r) for r in runs[:3]])
    out = np.empty(len(numbers), np.int64)
    out[starts[single]] = numbers[:first]
    out[starts[marked]] = numbers[first:second]
    out[starts[marked] + 1] = numbers[second:third]
    out[laid_out(starts[other], sizes[other])] = numbers[third:]
    return coded.dictionary, out, sizes


def text_words(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct matches of the pattern in the texts, their numbers in order, and the bounds of each text."""
    import regex

    plain = pattern == public_pattern()
    pieces, numbers, bounds = cut_pieces(texts, plain)
    words, own, sizes = piece_words(pieces, regex.compile(pattern).findall, plain)
    starts = np.cumsum(sizes) - sizes
    return words, own[laid_out(starts[numbers], sizes[numbers])], ends_of(sizes[numbers], bounds)


def corpus_words(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n): every match of the pattern in the corpus and how often it occurs.

    Tasks count before anything is shuffled; a task that holds too many distinct
    words hands on what it has and starts again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        held, rows = [], 0

        def counted() -> pa.Table:
            summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return summed.rename_columns({"n_sum": "n"}).select(["word", "n"]).cast(schema).combine_chunks()

        for batch in batches:
            words, numbers, _ = text_words(batch.column(0), pattern)
            n = np.bincount(numbers, minlength=len(words))
            held.append(pa.table([words.cast(pa.binary()), pa.array(n, pa.int64())], schema=schema))
            rows += len(words)
            if rows > 2 * COUNTED:
                held = [counted()]
                rows = held[0].num_rows
                if rows > COUNTED:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from counted().to_batches()

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_ids(words: DataFrame, table: RankTable, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes, and bounds and ids behind one another, of at most ``frequent`` words, the most frequent ones."""
    from xxhash import xxh64_intdigest

    words = materialise(words)
    least = frequency_floor(words, frequent)
    # Longer words are merged where they are met: neither folded nor sent to the driver.
    short = words.filter(F.octet_length("word") <= LONG)
    found = short.filter(F.col("n") >= least).select("word", merged_ranks(F.col("word"), table).alias("ids")).toArrow()
    ids = found["ids"].combine_chunks()
    # Chunk by chunk, so that the driver never holds every word as an object.
    hashes = np.fromiter((xxh64_intdigest(w) for b in found.to_batches(BATCH_ROWS) for w in b.column("word").to_pylist()), np.uint64)
    order = np.argsort(hashes)
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    sizes = np.diff(offsets)[order]
    packed = values[laid_out(offsets[:-1][order], sizes)].astype("<u4")
    return hashes[order], np.concatenate([[0], np.cumsum(sizes)]), packed


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "encoded", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with a struct ``out_col``: ids and decoded bytes (binary), n_tokens.

    ``ranks`` is the text of a rank file.  Frequent words of the corpus are folded once
    and go to every task in a table of bounded size; the distinct other words of each
    document are folded beside its text, so nothing is dropped and no text moves.
    ``ids`` holds little-endian unsigned 32-bit numbers.  Null text counts as empty and
    has no ids.  Words longer than ``LONG`` bytes are merged in the worker, since one
    fold step costs as much as the word is long.  A column named like ``out_col`` is
    replaced.
    """
    from xxhash import xxh64_intdigest

    spark = docs.sparkSession
    bounded_batches(spark)
    rank = parse_ranks(ranks)
    table = rank_literal(rank)
    give_back()  # the driver's share of what the table took
    shipped = spark.sparkContext.broadcast(frequent_ids(corpus_words(docs, pattern, text_col), table, frequent))
    give_back()
    vocabulary = spark.sparkContext.broadcast(rank)
    key = f"{zlib.crc32(ranks.encode())} {uuid.uuid4().hex}"

    def lookup(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, start and size of each one's, and which words are not in the table.

        The latter have the one id ``RARE``.
        """
        hashes, bounds, packed = shipped.value
        raw = words.cast(pa.binary()).to_pylist()
        hit, at = np.zeros(len(raw), bool), np.zeros(len(raw), np.int64)
        if len(hashes) and raw:
            hashed = np.array([xxh64_intdigest(w) for w in raw], np.uint64)
            order = np.argsort(hashed)  # neighbours in the table are met together
            at[order] = np.minimum(np.searchsorted(hashes, hashed[order]), len(hashes) - 1)
            hit = hashes[at] == hashed
        long = ~hit & (np.array([len(w) for w in raw], np.int64) > LONG)
        merged = [np.array(merge_long(raw[i], vocabulary.value), "<u4") for i in np.flatnonzero(long)]
        sizes = np.where(hit, bounds[at + hit] - bounds[at], 1)
        sizes[long] = [len(x) for x in merged]
        starts = np.cumsum(sizes) - sizes
        ids = np.full(sizes.sum(), RARE, "<u4")
        ids[laid_out(starts[hit], sizes[hit])] = packed[laid_out(bounds[at[hit]], sizes[hit])]
        ids[laid_out(starts[long], sizes[long])] = np.concatenate([np.empty(0, "<u4"), *merged])
        return ids, starts, sizes, ~(hit | long)

    @F.arrow_udf("struct<ids: binary, words: array<binary>>")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The ids of each text, with the number of a rare word in place of its ids."""
        worker_cache(key, "ids")
        for texts in batches:
            words, numbers, bounds = text_words(texts, pattern)
            ids, starts, sizes, rare = lookup(words)
            out = ids[laid_out(starts[numbers], sizes[numbers])]
            # The distinct rare words of each text, by text and word.
            at = np.flatnonzero(rare[numbers])
            text = np.searchsorted(bounds, at, "right") - 1
            own, which = np.unique(text * len(words) + numbers[at], return_inverse=True)
            owner, word = np.divmod(own, max(len(words), 1))
            firsts = np.searchsorted(owner, np.arange(len(bounds)))
            out[np.cumsum(sizes[numbers])[at] - 1] = RARE + which - firsts[text]
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), words.cast(pa.binary()).take(pa.array(word)))
            yield pa.StructArray.from_arrays([bytes_array(out, ends_of(sizes[numbers], bounds)), lists], names=["ids", "words"])

    largest = max(rank.values(), default=0)
    tokens = [b""] * (largest + 1)
    for token, n in rank.items():
        tokens[n] = token
    token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
    token_sizes = np.array([len(t) for t in tokens], np.int64)
    token_starts = np.cumsum(token_sizes) - token_sizes

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces the last two columns, numbered ids and the ids of rare words, by the result."""
        worker_cache(key, "ids")
        for batch in batches:
            numbered, folds = batch.columns[-2:]
            flat = folds.flatten()
            folded = flat.flatten()
            if flat.null_count or folded.null_count:
                raise ValueError("the rank file lacks single bytes")
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(numbered).to_numpy(zero_copy_only=False) // 4)]).astype(np.int64)
            ids = np.frombuffer(b"".join(numbered.to_pylist()), "<u4")
            at = np.flatnonzero(ids >= RARE)
            firsts = np.concatenate([[0], np.cumsum(pc.list_value_length(folds).to_numpy(zero_copy_only=False))]).astype(np.int64)
            fold_sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            fold_starts = np.cumsum(fold_sizes) - fold_sizes
            which = firsts[np.searchsorted(bounds, at, "right") - 1] + (ids[at] - RARE)
            starts, sizes = np.arange(len(ids)), np.ones(len(ids), np.int64)
            starts[at], sizes[at] = len(ids) + fold_starts[which], fold_sizes[which]
            ids = np.concatenate([ids, folded.to_numpy(zero_copy_only=False).astype("<u4")])[laid_out(starts, sizes)]
            bounds = ends_of(sizes, bounds)
            widths = token_sizes[ids]
            decoded = token_bytes[laid_out(token_starts[ids], widths)]
            parts = [bytes_array(ids, bounds), bytes_array(decoded, ends_of(widths, bounds)), pa.array(np.diff(bounds), pa.int64())]
            result = pa.StructArray.from_arrays(parts, names=["ids", "decoded", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], result], names=[*names, result_col])

    numbered, folds, result_col = fresh(docs, "_numbered"), fresh(docs, "_folds"), fresh(docs, "_result")
    names = docs.columns
    kind = StructType.fromDDL("ids binary, decoded binary, n_tokens long")
    folded = (
        docs.withColumn(numbered, number(F.col(text_col)))
        .select(*names, F.col(f"{numbered}.ids").alias(numbered), F.transform(F.col(f"{numbered}.words"), lambda w: merged_ranks(w, table)).alias(folds))
        .mapInArrow(assemble, StructType([*docs.schema.fields, StructField(result_col, kind)]))
    )
    return folded.drop(out_col).withColumnRenamed(result_col, out_col)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, with a heap of pairs."""
    n = len(word)
    stop = list(range(1, n + 1))  # end of the part that starts here; 0 if merged away
    before = list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = stop[i]
        if j >= n:
            return None
        rank = ranks.get(word[i : stop[j]])
        return None if rank is None else (rank, i, stop[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = stop[i]
        if not j or j >= n or stop[j] != end or not stop[j]:
            continue
        stop[i], stop[j] = end, 0
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out
