"""TF-IDF fit and top-k cosine retrieval over whole tables of queries.

Scoring touches only chunks that share a term with a query.  Text never travels
through the term join; it is fetched again for the k winners of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import RETRIEVAL_TOP_K
from gleaner.functions.text import retrieval_terms, term_counts
from gleaner.plans.sizing import (
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_ROWS,
    broadcast_if,
    fits_broadcast,
    materialise,
)

# Contract of a retriever: (queries, chunks, k) -> ranked(query_id, chunk_id, score, rank).
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]

# Scores are compared after rounding: the order in which a distributed sum adds
# doubles may differ between runs, and ties must not depend on it.
SCORE_DIGITS = 9

MAX_HOT_TERM_BYTES = 256
# Rows of one term that a task joins with the queries asking for it.
SALT_ROWS = 1_000_000

# Queries that are scored at once, and chunks that meet them at once.
QUERY_BLOCK = 1024
CHUNK_BLOCK = 2048
# Postings that meet the queries at once, where they are read by term.
POSTING_BLOCK = 1 << 16

_COUNT_ROW = ""  # no term is empty, so this row of the vocabulary counts chunks


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: ``scope..., term, df, idf`` (checkpointed)."""

    vocabulary: DataFrame
    scope: tuple[str, ...]
    small: bool  # the vocabulary may be broadcast whole
    hot_terms: int  # otherwise this many most frequent terms are broadcast


def fit(
    chunks: DataFrame,
    scope: Sequence[str] = (),
    broadcast_terms: int = MAX_BROADCAST_ROWS,
    refuse_empty: bool = False,
) -> TfidfModel:
    """Document frequencies with smooth idf ``ln((1+n)/(1+df))+1`` per scope.

    One pass over the text; a term repeated in many chunks is combined on the map
    side.  The chunk count of a scope rides along under an empty term.  With
    ``refuse_empty`` a corpus without any indexable term raises.
    """
    occurrences = chunks.select(
        *scope,
        F.explode_outer(
            F.array_union(
                F.array(F.lit(_COUNT_ROW)), F.array_distinct(retrieval_terms(F.col("text")))
            )
        ).alias("term"),
    )
    return _model(occurrences, tuple(scope), broadcast_terms, refuse_empty)


def _model(occurrences: DataFrame, scope: tuple[str, ...], broadcast_terms: int, refuse_empty: bool) -> TfidfModel:
    """The vocabulary of (scope..., term) rows, one empty term per chunk among them."""
    df = materialise(occurrences.groupBy(*scope, "term").agg(F.count("*").alias("df")))
    is_count = F.col("term") == _COUNT_ROW
    # One aggregate of the counts tells whether they fit, and whether there are any.
    size = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("bytes"),
        F.count(F.when(~is_count, 1)).alias("terms"),
        F.max(F.when(is_count, F.col("df"))).alias("chunks"),
    ).first()
    if refuse_empty and not size["terms"]:
        raise ValueError("no chunk holds an indexable term")
    if scope:
        totals = df.filter(is_count).select(*scope, F.col("df").alias("_n"))
        counted = df.filter(~is_count).join(totals, list(scope))
    else:
        counted = df.filter(~is_count).withColumn("_n", F.lit(size["chunks"] or 0))
    vocabulary = counted.select(
        *scope, "term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    return TfidfModel(
        vocabulary=vocabulary,
        scope=scope,
        small=size["rows"] <= broadcast_terms and size["bytes"] <= MAX_BROADCAST_BYTES,
        hot_terms=min(broadcast_terms, 100_000),
    )


@dataclass(frozen=True)
class Postings:
    """A corpus as retrieval reads it: numbered chunks with their counted terms, no text."""

    chunks: DataFrame  # scope..., chunk_no, chunk_id, terms: array of (term, tf); other columns
    model: TfidfModel
    own: bool = field(default=False, kw_only=True)  # the model was fitted on these chunks, so it knows their terms

    @property
    def rows(self) -> DataFrame:
        """``scope..., chunk_no, term, tf``; the outer ``inline`` keeps a filter from being inferred."""
        posted = self.chunks.select(*self.model.scope, "chunk_no", F.inline_outer("terms"))
        return posted.filter(F.col("term").isNotNull())

    @property
    def reads_by_term(self) -> bool:
        """Whether postings are found by their term, so that a query need not read them all."""
        return False

    def rows_for(self, asked: DataFrame) -> DataFrame:
        """At least the rows of the terms in ``asked``."""
        return self.rows

    @property
    def norms(self) -> DataFrame:
        """``scope..., chunk_no, norm``; the rows of a chunk lie together, so they are summed before the shuffle."""
        weight = F.col("tf") * F.col("idf")
        weighted = _with_idf(self.rows, self.model, self.model.vocabulary)
        return weighted.groupBy(*self.model.scope, "chunk_no").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def count_terms(chunks: DataFrame, *keep: str, write: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """Chunks with ``chunk_no`` and ``terms`` instead of their text, written once."""
    counted = chunks.select("chunk_id", *keep, term_counts(retrieval_terms(F.col("text"))).alias("terms"))
    return write(counted.withColumn("chunk_no", F.monotonically_increasing_id()))


def post(
    counted: DataFrame,
    scope: Sequence[str] = (),
    model: TfidfModel | None = None,
    refuse_empty: bool = False,
) -> Postings:
    """The vocabulary over counted chunks (``count_terms``), without reading any text."""
    scope, own = tuple(scope), model is None
    if own:
        each = F.concat(F.array(F.lit(_COUNT_ROW)), F.transform("terms", lambda t: t["term"]))
        occurrences = counted.select(*scope, F.explode_outer(each).alias("term"))
        model = _model(occurrences, scope, MAX_BROADCAST_ROWS, refuse_empty)
    return Postings(counted, model, own=own)


def index(chunks: DataFrame, scope: Sequence[str] = (), model: TfidfModel | None = None) -> Postings:
    """``chunks`` (scope..., chunk_id, text) in one pass over the text."""
    return post(count_terms(chunks, *scope), scope, model)


def _most_frequent(model: TfidfModel, vocabulary: DataFrame) -> DataFrame:
    """The most frequent terms, bounded in rows and in bytes: overlong ones are left out."""
    short = vocabulary.filter(F.octet_length("term") <= MAX_HOT_TERM_BYTES)
    return short.orderBy(F.col("df").desc(), *model.scope, "term").limit(model.hot_terms)


def _with_idf(pairs: DataFrame, model: TfidfModel, vocabulary: DataFrame) -> DataFrame:
    """Attach vocabulary columns to (chunk, term) rows.

    A vocabulary above the broadcast bound is split: its most frequent terms, a
    bounded number, are broadcast, which takes the bulk and every hot key out of
    the shuffle; the H-th most frequent term owns at most 1/H of all pairs, so
    the remaining keys are small.
    """
    on = [*model.scope, "term"]
    if model.small:
        return pairs.join(F.broadcast(vocabulary), on)
    most_frequent = _most_frequent(model, vocabulary)
    hot, hot_keys = F.broadcast(most_frequent), F.broadcast(most_frequent.select(*on))
    frequent = pairs.join(hot, on)
    rare = pairs.join(hot_keys, on, "left_anti").join(
        vocabulary.join(hot_keys, on, "left_anti"), on
    )
    return frequent.unionByName(rare)


def query_vectors(queries: DataFrame, model: TfidfModel) -> DataFrame:
    """``scope..., query_id, term, df, idf, qw``: unit query vectors over known terms."""
    counts = queries.select(
        *model.scope, "query_id", term_counts(retrieval_terms(F.col("query_text"))).alias("_t")
    ).select(*model.scope, "query_id", F.inline("_t"))
    on = [*model.scope, "term"]
    weighted = counts.join(model.vocabulary, on).select(
        *model.scope, "query_id", "term", "df", "idf", (F.col("tf") * F.col("idf")).alias("w")
    )
    per_query = Window.partitionBy(*model.scope, "query_id")
    return weighted.select(
        *model.scope,
        "query_id",
        "term",
        "df",
        "idf",
        (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_query))).alias("qw"),
    )


def _steps(score: Column) -> Column:
    """The score counted in its last compared digit; decimal rounding of doubles is slow."""
    return F.floor(score * 10.0**SCORE_DIGITS + 0.5)


def top_k(scored: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Best ``k`` per key by (score desc, chunk_id), ranks from 0.

    Planned as a window group limit: every task keeps k rows per key before the
    shuffle."""
    best_first = Window.partitionBy(*keys).orderBy(
        _steps(F.col("score")).desc(), F.col("chunk_id")
    )
    return (
        scored.withColumn("_r", F.row_number().over(best_first))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.col("_r") - 1)
        .drop("_r")
    )


def _first_ids(chunks: DataFrame, k: int, scope: Sequence[str]) -> DataFrame:
    """The k smallest chunk ids of a scope as one sorted array."""
    if scope:
        smallest = Window.partitionBy(*scope).orderBy("chunk_id")
        few = (
            chunks.select(*scope, "chunk_id")
            .withColumn("_r", F.row_number().over(smallest))
            .filter(F.col("_r") <= k)
        )
        return few.groupBy(*scope).agg(
            F.array_sort(F.collect_list("chunk_id")).alias("_pool")
        )
    return (
        chunks.select("chunk_id")
        .orderBy("chunk_id")
        .limit(k)
        .agg(F.array_sort(F.collect_list("chunk_id")).alias("_pool"))
    )


def _pad(
    queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int, scope: Sequence[str]
) -> DataFrame:
    """Fill short results with zero-score chunks in id order.

    Of the k smallest ids at most ``hits`` are hits, so k - hits are not: the
    fill is exact and needs neither an anti-join nor a cross join.
    """
    keys = [*scope, "query_id"]
    found = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("_hits")
    )
    none = F.expr("cast(array() as array<struct<rank:int,chunk_id:string,score:double>>)")
    listed = queries.select(*keys).join(found, keys, "left")
    pool = _first_ids(chunks, k, scope)
    if scope:
        listed = listed.join(pool, list(scope))
    else:
        listed = listed.withColumn("_pool", pool.scalar())
    listed = listed.withColumn("_hits", F.coalesce("_hits", none))
    fill = F.slice(
        F.array_except("_pool", F.transform("_hits", lambda h: h["chunk_id"])),
        F.lit(1),
        F.lit(k) - F.size("_hits"),
    )
    padded = F.transform(
        fill,
        lambda c, i: F.struct(
            (F.size("_hits") + i).alias("rank"), c.alias("chunk_id"), F.lit(0.0).alias("score")
        ),
    )
    return listed.select(*keys, F.inline(F.concat("_hits", padded)))


def scores(
    queries: DataFrame,
    postings: Postings,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Cosine of every (query, chunk) pair that shares a term: scope..., chunk_no, query_id, score.

    A query side within the broadcast bound meets the postings where they are.
    Beyond it both sides are shuffled by term, and a term found in many chunks is
    split into parts of about ``salt_rows`` postings, its query rows being
    repeated for every part.
    """
    scope = list(postings.model.scope)
    on = [*scope, "term"]
    vectors = materialise(query_vectors(queries, postings.model))
    rows = postings.rows_for(vectors)
    small_queries = fits_broadcast(vectors, "term", max_rows=max_broadcast_rows)
    if not small_queries:
        parts = F.ceil(F.col("df") / salt_rows).cast("int")
        terms = vectors.select(*on, parts.alias("_parts")).distinct()
        rows = _with_parts(rows, terms, on).withColumn("_part", F.pmod(F.xxhash64("chunk_no"), F.col("_parts")).cast("int"))
        vectors = vectors.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        on = [*on, "_part"]
    asked = vectors.select(*on, "query_id", (F.col("idf") * F.col("qw")).alias("_w"))
    dots = (
        rows.join(broadcast_if(small_queries, asked), on)
        .groupBy(*scope, "chunk_no", "query_id")
        .agg(F.sum(F.col("tf") * F.col("_w")).alias("_dot"))
    )
    return dots.join(postings.norms, [*scope, "chunk_no"]).select(
        *scope, "chunk_no", "query_id", (F.col("_dot") / F.col("norm")).alias("score")
    )


def _with_parts(rows: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """Postings of asked terms with their number of parts.

    Terms that fit a broadcast take out all other postings before the shuffle.  Of more
    terms only the hot ones, few by nature, are looked up; the rest has one part and is
    left to the join that follows.
    """
    if fits_broadcast(terms, "term"):
        return rows.join(F.broadcast(terms), on)
    hot = terms.filter("_parts > 1")
    found = rows.join(broadcast_if(fits_broadcast(hot, "term"), hot), on, "left")
    return found.withColumn("_parts", F.coalesce("_parts", F.lit(1)))


@dataclass(frozen=True)
class _Asked:
    """A bounded block of queries as tasks read it.

    ``shipped``: the terms sent, their idf, where the weights of each term begin, and the
    queries and values of all weights."""

    shipped: Broadcast
    queries: np.ndarray
    scopes: dict
    kinds: list[pa.DataType]  # of the scope columns and the query's id

    def named(self, found: pd.DataFrame) -> list[pa.Array]:
        """Scope columns and query ids of rows whose ``q`` numbers the query."""
        own = [pa.array([self.scopes[q][i] for q in found["q"]], type=kind) for i, kind in enumerate(self.kinds[:-1])]
        return [*own, pa.array(self.queries[found["q"]], type=self.kinds[-1])]

    def dots(self, at: np.ndarray, tf: np.ndarray, chunk: np.ndarray, chunks: int) -> np.ndarray:
        """Products of ``chunks`` chunks with all queries, from the places of their terms."""
        _, _, starts, query, weight = self.shipped.value
        times = starts[at + 1] - starts[at]
        hit = np.repeat(np.arange(len(at)), times)
        slot = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[at], times)
        width = len(self.queries)
        return np.bincount(chunk[hit] * width + query[slot], tf[hit] * weight[slot], chunks * width).reshape(-1, width).astype(float)


def _keyed(scope: Sequence[str], term: Column) -> Column:
    """A term with its scope before it."""
    return F.concat_ws("\x1f", *[F.col(s).cast("string") for s in scope], term) if scope else term


def _ask(vocabulary: DataFrame, vectors: DataFrame, scope: list[str]) -> _Asked:
    """Send the queries with the idf of ``vocabulary``, which has their terms."""
    key = _keyed(scope, F.col("term")).alias("term")
    known = vocabulary.select(key, "idf").toArrow()
    asked = vectors.select(key, *scope, "query_id", (F.col("idf") * F.col("qw")).alias("w")).toArrow()
    queries, of_query = np.unique(asked["query_id"].to_numpy(zero_copy_only=False), return_inverse=True)
    scopes = {q: tuple(asked[s][i].as_py() for s in scope) for i, q in enumerate(of_query.tolist())}
    place = pc.index_in(asked["term"], value_set=known["term"].combine_chunks()).to_numpy()
    order = np.argsort(place, kind="stable")
    shipped = vectors.sparkSession.sparkContext.broadcast((
        known["term"].combine_chunks(), known["idf"].to_numpy(), np.searchsorted(place[order], np.arange(len(known) + 1)),
        of_query[order], asked["w"].to_numpy()[order],
    ))
    return _Asked(shipped, queries, scopes, [asked[c].type for c in (*scope, "query_id")])


def _counted(postings: Postings, scope: list[str], *columns: str) -> DataFrame:
    keyed = F.transform("terms", lambda t: t.withField("term", _keyed(scope, t["term"]))) if scope else F.col("terms")
    return postings.chunks.select(*columns, keyed.alias("terms"))


def _best_in_task(postings: Postings, vectors: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query in each task: scope..., query_id, chunk_id, score.

    For a bounded block of queries.  A batch of chunks is multiplied with all queries at
    once and no (query, chunk) pair leaves the task unless it is among the k best there,
    ties going to the smaller id.  Norms are taken in the task from a vocabulary that
    fits; over a larger one see :func:`_best_by_bounds`.
    """
    scope = list(postings.model.scope)
    if not postings.model.small:
        return _best_by_bounds(postings, vectors, k)
    asked = _ask(postings.model.vocabulary, vectors, scope)

    def score(ids: pa.Array, terms: pa.Array, counts: pa.Array, sizes: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
        vocabulary, idf = asked.shipped.value[:2]
        at = pc.index_in(terms, value_set=vocabulary)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)  # every term is in the vocabulary
        tf, chunk = counts.to_numpy().astype(float), np.repeat(np.arange(len(sizes)), sizes)
        norm = np.sqrt(np.bincount(chunk, (tf * idf[at]) ** 2, len(sizes)).astype(float))
        dots = asked.dots(at, tf, chunk, len(sizes))
        scores = np.divide(dots, norm[:, None], out=np.zeros_like(dots), where=norm[:, None] > 0)
        steps = np.floor(scores * 10.0**SCORE_DIGITS + 0.5)
        least = np.maximum(bounds, _kth(steps, k))
        row, column = np.nonzero((steps >= least) & (dots > 0))
        return pd.DataFrame({"q": column, "step": steps[row, column], "score": scores[row, column], "chunk_id": ids.take(pa.array(row)).to_pandas()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds = None, np.zeros(len(asked.queries))
        for batch in batches if len(asked.queries) else ():  # no query may have a known term
            for cut in range(0, batch.num_rows, CHUNK_BLOCK):
                part = batch.slice(cut, CHUNK_BLOCK)
                listed = part.column("terms")
                flat = listed.flatten()
                found = score(part.column("chunk_id"), flat.field("term"), flat.field("tf"), pc.list_value_length(listed).to_numpy(zero_copy_only=False), bounds)
                held = found if held is None else pd.concat([held, found], ignore_index=True)
                held = held.sort_values(["q", "step", "chunk_id"], ascending=[True, False, True]).groupby("q").head(k)
                _raise(bounds, held, "step", k)
        if held is not None and len(held):
            columns = [*asked.named(held), pa.array(held["chunk_id"]), pa.array(held["score"])]
            yield pa.RecordBatch.from_arrays(columns, names=[*scope, "query_id", "chunk_id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *postings.chunks.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*scope, "query_id", "chunk_id")) + ", score double"
    return _counted(postings, scope, "chunk_id").mapInArrow(run, schema)


def _best_by_posting(postings: Postings, vectors: DataFrame, k: int) -> DataFrame:
    """:func:`_best_in_task` from postings that are found by their term, with stored norms.

    Postings of asked terms travel by number to the norm and the id of their chunk; what
    leaves a task is k rows per query, never a (query, chunk) pair.
    """
    scope = list(postings.model.scope)
    keys = [*scope, "query_id"]
    vectors = vectors.filter(F.col("query_id").isNotNull())  # no result is kept for a query without an id
    asked = _ask(vectors.select(*scope, "term", "idf").distinct(), vectors, scope)
    places = pa.table({"_key": asked.shipped.value[0], "place": np.arange(len(asked.shipped.value[0]), dtype=np.int32)})
    places = vectors.sparkSession.createDataFrame(places.cast(pa.schema([("_key", pa.string()), ("place", pa.int32())])))
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *postings.chunks.schema]}
    nothing = {"place": "int", "tf": "int", "norm": "double", "chunk_id": kinds["chunk_id"]}
    row = lambda **has: ["chunk_no", *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in nothing.items()]]
    keyed = postings.rows_for(vectors).withColumn("_key", _keyed(scope, F.col("term")))
    found = keyed.join(F.broadcast(places), "_key").select(*row(place=F.col("place"), tf=F.col("tf")))
    about = postings.norms.select(*row(norm=F.col("norm"))).unionByName(postings.chunks.select(*row(chunk_id=F.col("chunk_id"))))

    def score(rows: pa.Table, bounds: np.ndarray) -> pd.DataFrame:
        number = rows["chunk_no"].to_numpy()
        chunk = np.cumsum(np.diff(number, prepend=number[:1]) != 0)
        n = int(chunk[-1]) + 1
        place = pc.fill_null(rows["place"], -1).to_numpy()
        norm = pc.fill_null(rows["norm"], 0.0).to_numpy()
        hit, norm = np.flatnonzero(place >= 0), np.bincount(chunk, norm, n)
        dots = asked.dots(place[hit], rows["tf"].take(pa.array(hit)).to_numpy().astype(float), chunk[hit], n)
        scores = np.divide(dots, norm[:, None], out=np.zeros_like(dots), where=norm[:, None] > 0)
        steps = np.floor(scores * 10.0**SCORE_DIGITS + 0.5)
        at, column = np.nonzero((steps >= np.maximum(bounds, _kth(steps, k))) & (dots > 0))
        named = np.zeros(n, np.int64)  # a chunk's id stands in its row without place and norm
        other = np.flatnonzero((place < 0) & rows["norm"].is_null().to_numpy())
        named[chunk[other]] = other
        return pd.DataFrame({"q": column, "step": steps[at, column], "score": scores[at, column], "chunk_id": rows["chunk_id"].take(pa.array(named[at])).to_pandas()})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole chunks, in tables of about ``POSTING_BLOCK`` rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < POSTING_BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            number = rows["chunk_no"].to_numpy()
            cut = int(np.searchsorted(number, number[-1]))
            held = rows.slice(cut).to_batches()
            if cut:
                yield rows.slice(0, cut)
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds = None, np.zeros(len(asked.queries))
        for rows in blocks(batches) if len(asked.queries) else ():
            new = score(rows, bounds)
            held = new if held is None else pd.concat([held, new], ignore_index=True)
            held = held.sort_values(["q", "step", "chunk_id"], ascending=[True, False, True], na_position="first").groupby("q").head(k)
            _raise(bounds, held, "step", k)
        if held is not None and len(held):
            columns = [*asked.named(held), pa.array(held["chunk_id"]), pa.array(held["score"])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "chunk_id", "score"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "chunk_id")) + ", score double"
    together = found.unionByName(about).repartition("chunk_no").sortWithinPartitions("chunk_no")
    return together.mapInArrow(run, schema)


def _kth(steps: np.ndarray, k: int) -> np.ndarray | int:
    """The k-th largest of each column."""
    return np.partition(steps, len(steps) - k, axis=0)[len(steps) - k] if len(steps) > k else 0


def _raise(bounds: np.ndarray, held: pd.DataFrame, column: str, k: int) -> None:
    """Set the bound of each query that has k rows to the least of these."""
    full = held.groupby("q")[column].agg(["size", "min"])
    full = full[full["size"] >= k]
    bounds[full.index.to_numpy()] = full["min"].to_numpy()


def _best_by_bounds(postings: Postings, vectors: DataFrame, k: int) -> DataFrame:
    """:func:`_best_in_task` over a vocabulary that is not sent whole.

    The most frequent terms and the asked ones are sent.  The other terms of a chunk have
    an idf between two bounds, so its score lies between two values, and a task gives up
    only chunks that k others of it surely beat; of equal chunks it keeps the k of smallest
    id.  What is left, k and a few per query and task, is held against the k-th best of all
    tasks and then meets the exact idf of its other terms.
    """
    model, scope = postings.model, list(postings.model.scope)
    keys = [*scope, "query_id"]
    hot = materialise(_most_frequent(model, model.vocabulary))
    floor = hot.agg(F.min("df").alias("df")).first()["df"]
    short = (F.octet_length("term") <= MAX_HOT_TERM_BYTES) & (F.col("df") <= (2**62 if floor is None else floor))
    limits = model.vocabulary.agg(F.min(F.when(short, F.col("idf"))).alias("least"), F.max("idf").alias("most")).first()
    # An idf is at least 1; a term that another corpus' model does not know counts nothing.
    least, overlong = (limits["least"] or 0.0, 1.0) if postings.own else (0.0, 0.0)
    most = limits["most"] or 0.0
    asked = _ask(hot.select(*scope, "term", "idf").unionByName(vectors.select(*scope, "term", "idf")).distinct(), vectors, scope)
    names = ["q", "least", "most", "dot", "square", "chunk_no", "chunk_id", "rest"]

    def score(part: pa.RecordBatch, bounds: np.ndarray) -> pd.DataFrame:
        vocabulary, idf = asked.shipped.value[:2]
        listed = part.column("terms")
        flat, n = listed.flatten(), len(listed)
        at = pc.fill_null(pc.index_in(flat.field("term"), value_set=vocabulary), -1).to_numpy().astype(np.int64)
        tf = flat.field("tf").to_numpy().astype(float)
        chunk = np.repeat(np.arange(n), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        known, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        dots = asked.dots(at[known], tf[known], chunk[known], n)
        square = np.bincount(chunk[known], (tf[known] * idf[at[known]]) ** 2, n).astype(float)
        rest = flat.take(pa.array(other))
        long = pc.binary_length(rest.field("term")).to_numpy() > MAX_HOT_TERM_BYTES
        low = square + np.bincount(chunk[other], (tf[other] * np.where(long, overlong, least)) ** 2, n)
        high = square + np.bincount(chunk[other], (tf[other] * most) ** 2, n)

        def steps(squares: np.ndarray) -> np.ndarray:
            norm = np.sqrt(squares)[:, None]
            return np.floor(np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0) * 10.0**SCORE_DIGITS + 0.5)

        at_least, at_most = steps(high) - 1, steps(low) + 1  # a step for rounding
        row, column = np.nonzero((at_most >= np.maximum(bounds, _kth(at_least, k))) & (dots > 0))
        offsets = pa.array(np.searchsorted(chunk[other], np.arange(n + 1)), pa.int32())
        rest = pa.ListArray.from_arrays(offsets, rest)
        own = {r: tuple((t["term"], t["tf"]) for t in rest[r].as_py()) for r in set(row.tolist())}
        taken = pa.array(row)
        values = [
            column, at_least[row, column], at_most[row, column], dots[row, column], square[row],
            part.column("chunk_no").take(taken).to_pandas(), part.column("chunk_id").take(taken).to_pandas(),
            pd.Series([own[r] for r in row.tolist()], dtype=object),
        ]
        return pd.DataFrame(dict(zip(names, values, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds = None, np.zeros(len(asked.queries))
        for batch in batches if len(asked.queries) else ():
            for cut in range(0, batch.num_rows, CHUNK_BLOCK):
                found = score(batch.slice(cut, CHUNK_BLOCK), bounds)
                if held is not None and not len(found):
                    continue
                held = found if held is None else pd.concat([held, found], ignore_index=True)
                held = held.sort_values(["q", "least", "chunk_id"], ascending=[True, False, True])
                held = held.groupby(["q", "dot", "square", "rest"], sort=False).head(k)
                _raise(bounds, held.groupby("q").head(k), "least", k)
                held = held[held["most"].to_numpy() >= bounds[held["q"].to_numpy()]]
        if held is not None and len(held):
            rest = pa.array([[{"term": t, "tf": n} for t, n in own] for own in held["rest"]], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*asked.named(held), *[pa.array(held[c]) for c in names[1:-1]], rest], names=[*keys, *names[1:]])

    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *postings.chunks.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", least double, most double, dot double, square double, chunk_no long"
    read = _counted(postings, scope, "chunk_no", "chunk_id")
    found = materialise(read.mapInArrow(run, f"{schema}, chunk_id {kinds['chunk_id']}, rest array<struct<term:string,tf:int>>"))
    by_least = Window.partitionBy(*keys).orderBy(F.col("least").desc())
    beaten = found.select(*keys, "least").withColumn("_r", F.row_number().over(by_least)).filter(F.col("_r") <= k)
    beaten = beaten.filter(F.col("_r") == k).select(*keys, F.col("least").alias("_least"))
    near = found.join(F.broadcast(beaten), keys, "left").filter(F.col("most") >= F.coalesce("_least", "most"))
    near = materialise(near.select(*keys, "chunk_no", "chunk_id", "dot", "square", "rest"))
    others = near.select("chunk_no", F.inline("rest")).distinct()
    weight = F.col("tf") * F.col("idf")
    known = model.vocabulary.select(_keyed(scope, F.col("term")).alias("term"), "idf")
    more = known.join(broadcast_if(fits_broadcast(others, "term"), others), "term").groupBy("chunk_no").agg(F.sum(weight * weight).alias("_more"))
    norm = F.sqrt(F.col("square") + F.coalesce("_more", F.lit(0.0)))
    return near.join(more, "chunk_no", "left").select(*keys, "chunk_id", (F.col("dot") / norm).alias("score"))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame | Postings,
    k: int = RETRIEVAL_TOP_K,
    model: TfidfModel | None = None,
    scope: Sequence[str] = (),
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Top ``k`` chunks per query: ``scope..., query_id, chunk_id, score, rank``.

    ``chunks`` with text, or their postings.  A query always gets k rows when the corpus
    has k chunks: zero-score chunks fill the remaining places in id order.  Up to
    ``query_block`` queries are scored where the chunks lie, or where the postings of
    their terms meet; beyond, terms are joined (:func:`scores`).
    """
    postings = chunks if isinstance(chunks, Postings) else index(chunks, model.scope if model else scope, model)
    scope = postings.model.scope
    keys = [*scope, "query_id"]
    vectors = materialise(query_vectors(queries, postings.model))
    few = vectors.select("query_id").distinct().count() <= query_block and fits_broadcast(vectors, "term")
    if few:
        best = _best_by_posting if postings.reads_by_term else _best_in_task
        hits = top_k(best(postings, vectors, k), k, keys)
    else:
        # Pairs travel by number; ids are fetched for the best k scores of a query, ties
        # included, and break the ties.
        best = Window.partitionBy(*keys).orderBy(_steps(F.col("score")).desc())
        top = scores(queries, postings).withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= k).drop("_r")
        named = top.join(postings.chunks.select(*scope, "chunk_no", "chunk_id"), [*scope, "chunk_no"])
        hits = top_k(named.drop("chunk_no"), k, keys)
    ranked = _pad(queries, hits, postings.chunks, k, scope)
    return ranked.select(*scope, "query_id", "chunk_id", "score", "rank")


def with_chunk_columns(
    ranked: DataFrame,
    chunks: DataFrame,
    columns: Sequence[str],
    scope: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Join chunk columns back onto ranked rows.

    ``max_rows`` is a proven bound of the ranked side (queries times k); within
    the broadcast bound the chunk table is streamed once and not shuffled.
    """
    on = [*scope, "chunk_id"]
    side = chunks.select(*on, *[c for c in columns if c not in on])
    small = max_rows is not None and max_rows <= MAX_BROADCAST_ROWS // 2
    return side.join(broadcast_if(small, ranked), on)


def chunks_for_docs(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id"), "doc_id", "left_semi")


def assign_labels(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """``label`` = 1 where the ranked pair is an evidence pair."""
    known = evidence.select("query_id", "chunk_id").distinct().withColumn("_e", F.lit(True))
    return ranked.join(known, ["query_id", "chunk_id"], "left").select(
        *[F.col(c) for c in ranked.columns], F.col("_e").isNotNull().cast("int").alias("label")
    )


def select_by_score(ranked: DataFrame, threshold: float | Column) -> DataFrame:
    """Baseline: keep pairs whose retrieval score clears the threshold."""
    return ranked.filter(F.col("score") >= threshold)


def select_top_k(ranked: DataFrame, k: int | Column) -> DataFrame:
    """Baseline: keep the first ``k`` by rank."""
    return ranked.filter(F.col("rank") < k)
