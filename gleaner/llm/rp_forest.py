"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are grown on a bounded sample (``SAMPLE`` rows); every vector is then put
into one leaf of each tree.  A query walks all trees with one priority queue, nearest
unexplored half-space first, until the leaves it has opened hold its share of rows,
and the vectors there are ranked by exact cosine in double precision.

Equal vectors are one row of the index that carries their smallest ids, which is all a
result can hold; equal queries are searched once.  How many leaves a query opens is a
share of the table, since nothing less reaches the recall on vectors without structure.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.sizing import materialise

TREES = 16
LEAF = 32
# Rows the trees are grown on, in expectation.
SAMPLE = 1 << 16
# Rows in the leaves a query opens, counted once per tree: a share of the table, and at least so many.
SHARE, LEAST = 0.6, 6000
# Vectors of one tree that meet in one task.
PART_ROWS = 1 << 16
# Distinct queries that meet a part in one task, and that one task walks through the trees.
BLOCK_QUERIES, PROBE_QUERIES = 1 << 12, 64
K = 5


@dataclass
class Tree:
    """A balanced tree: node i has children 2i + 1 and 2i + 2."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", vectors, self.planes[node]) > self.offsets[node]
            node = 2 * node + 1 + side
        return node - (len(self.planes))


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the difference of two random rows of a node."""
    width = sample.shape[1]
    planes, offsets = np.zeros((2**depth - 1, width), np.float32), np.zeros(2**depth - 1, np.float32)
    node = np.zeros(len(sample), np.int64)
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        first = 2**level - 1
        bounds = np.searchsorted(node[order], np.arange(first, first + 2**level + 1))
        for k in range(2**level):
            rows = order[bounds[k] : bounds[k + 1]]
            plane = rng.standard_normal(width)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                if (sample[a] != sample[b]).any():
                    plane = sample[a] - sample[b]
            planes[first + k] = plane / np.linalg.norm(plane)
            if len(rows):
                offsets[first + k] = np.median(sample[rows] @ planes[first + k])
        side = np.einsum("ij,ij->i", sample, planes[node]) > offsets[node]
        node = 2 * node + 1 + side
    return Tree(planes, offsets, depth)


def open_leaves(trees: list[Tree], query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees."""
    margins = [tree.planes @ query - tree.offsets for tree in trees]
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    out = []
    while queue and len(out) < wanted:
        far, t, node = heapq.heappop(queue)
        inner = len(margins[t])
        while node < inner:
            margin = float(margins[t][node])
            right = margin > 0
            heapq.heappush(queue, (max(far, abs(margin)), t, 2 * node + 2 - right))
            node = 2 * node + 1 + right
        out.append((t, node - inner))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _stack(blobs: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1, so no norm over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each row, ties to the smaller id."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(score, top, 1).min(axis=1)
    tied = np.flatnonzero((score >= least[:, None]).sum(axis=1) > k)
    if len(tied):
        top[tied] = np.lexsort((ids[tied], -score[tied]), axis=1)[:, :k]
    return top


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, blob): whole, finite, non-zero vectors as packed doubles."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.filter(F.col("id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Adding zero turns -0.0 into 0.0, so that equal vectors have equal bytes.
            yield pd.DataFrame({"id": frame["id"], "blob": [(np.asarray(v, np.float64) + 0.0).tobytes() for v in frame["v"]]})

    return kept.mapInPandas(packed, "id long, blob binary")


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query.

    A query is not its own candidate.  Null, zero and non-finite vectors, rows without
    an id, and vectors of another width than most take no part.  Ties go to the smaller
    id.  Rows that repeat an id and vector count once; an id with two vectors is two
    candidates.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(_usable(vectors, id_col, vector_col).distinct())
    asked = materialise(_usable(queries, id_col, vector_col).distinct())
    common = rows.groupBy(F.octet_length("blob").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = common["w"] // 8
    rows = rows.filter(F.octet_length("blob") == 8 * width)
    asked = asked.filter(F.octet_length("blob") == 8 * width)
    # The k + 1 smallest ids of each vector, found in slices first so that no task sorts them all.
    keyed = rows.withColumn("key", F.xxhash64("blob")).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(1024)))
    for by in (["blob", "key", "slice"], ["blob", "key"]):
        order = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        keyed = keyed.withColumn("_n", order).filter(F.col("_n") <= k + 1).drop("_n")
    index = materialise(keyed.groupBy("blob", "key").agg(F.collect_set("id").alias("ids")))
    total = index.count()
    drawn = index.filter(F.pmod(F.xxhash64("key"), F.lit(total)) < SAMPLE).select("blob").toPandas()["blob"]
    sample = _unit(_stack(drawn, width)).astype(np.float32) if len(drawn) else np.zeros((0, width), np.float32)
    depth = int(np.ceil(np.log2(max(1.0, len(sample) / LEAF))))
    rng = np.random.default_rng(5)
    # Plain arrays, since a broadcast value does not carry the code of its classes.
    grown = [grow(sample, depth, rng) for _ in range(TREES)]
    shipped = spark.sparkContext.broadcast([(tree.planes, tree.offsets, tree.depth) for tree in grown])
    wanted = int(np.ceil(max(share * total, LEAST) * 2**depth / total))
    parts = 1 + total // PART_ROWS
    asking = materialise(asked.select("blob").distinct().withColumn("key", F.xxhash64("blob")))
    n_asking = asking.count()
    blocks = 1 + n_asking // BLOCK_QUERIES

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = _unit(_stack(frame["blob"], width)).astype(np.float32) if len(frame) else np.zeros((0, width), np.float32)
            for t, tree in enumerate(shipped.value):
                yield frame.assign(tree=t, leaf=Tree(*tree).leaves(units))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree(*tree) for tree in shipped.value]
        for frame in frames:
            out = []
            for key, blob in zip(frame["key"], frame["blob"], strict=True):
                unit = _unit(_stack([blob], width))[0].astype(np.float32)
                found = pd.DataFrame(open_leaves(trees, unit, wanted), columns=["tree", "leaf"])
                for (t, part), own in found.groupby(["tree", found["leaf"] % parts]):
                    out.append((key, blob, int(t), int(part), key % blocks, own["leaf"].tolist()))
            yield pd.DataFrame(out, columns=["key", "blob", "tree", "part", "block", "leaves"])

    def rank(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The best of the opened leaves of one tree and part, for each query."""
        columns = ["key", "ids", "score"]
        if not len(queries) or not len(found):
            return pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in zip(columns, (int, object, float), strict=True)})
        q, v = _scaled(_stack(queries["blob"], width)), _scaled(_stack(found["blob"], width))
        # The smallest id of each vector, and of no vector.
        smallest = np.append([min(x) for x in found["ids"]], np.iinfo(np.int64).max)
        q_size, v_size = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        order = np.argsort(found["leaf"].to_numpy(), kind="stable")
        leaves, bounds = np.unique(found["leaf"].to_numpy()[order], return_index=True)
        inside = dict(zip(leaves.tolist(), np.split(order, bounds[1:]), strict=True))
        askers: dict[int, list[int]] = {}
        for i, own in enumerate(queries["leaves"]):
            for leaf in own:
                askers.setdefault(int(leaf), []).append(i)
        best = np.full((len(q), k + 1), -np.inf)
        at = np.full((len(q), k + 1), -1)
        for leaf, members in inside.items():
            if leaf not in askers:
                continue
            who = np.array(askers[leaf])
            score = (q[who] @ v[members].T) / (q_size[who, None] * v_size[members])
            score = np.concatenate([best[who], score], axis=1)
            place_of = np.concatenate([at[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
            top = _best(score, smallest[place_of], k + 1)
            best[who] = np.take_along_axis(score, top, 1)
            at[who] = np.take_along_axis(place_of, top, 1)
        i, j = np.nonzero(at >= 0)
        return pd.DataFrame(
            {"key": queries["key"].to_numpy()[i], "ids": found["ids"].to_numpy()[at[i, j]], "score": best[i, j]}
        )

    placed = index.mapInPandas(place, "blob binary, key long, ids array<long>, tree int, leaf long")
    # A vector meets every block of queries; the blocks bound what one task holds of them.
    placed = placed.withColumn("part", (F.col("leaf") % parts).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    probes = (
        asking.repartition(1 + min(n_asking // PROBE_QUERIES, 10_000)).select("key", "blob")
        .mapInPandas(probe, "key long, blob binary, tree int, part int, block int, leaves array<long>")
    )
    near = (
        probes.groupBy("tree", "part", "block")
        .cogroup(placed.groupBy("tree", "part", "block"))
        .applyInPandas(rank, "key long, ids array<long>, score double")
    )
    # Of each distinct query the k + 1 nearest ids; a query then leaves itself out.
    # Trees may round the score of one pair differently.
    found = near.select("key", "score", F.explode("ids").alias("vec_id"))
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = materialise(
        found.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= k + 1)
        .groupBy("key").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    )
    own = (
        asked.select(F.col("id").alias("query_id"), F.xxhash64("blob").alias("key"))
        .join(found, "key")
        .select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
        .select("query_id", F.slice(F.sort_array(F.transform("near", lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("id")))), 1, k).alias("near"))
    )
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
