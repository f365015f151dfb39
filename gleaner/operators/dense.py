"""Dense retrieval: exact cosine top-k, and latent vectors of the TF-IDF matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import RETRIEVAL_TOP_K
from gleaner.functions.text import retrieval_terms
from gleaner.operators.retrieval import SCORE_DIGITS, top_k
from gleaner.plans.sizing import materialise

QUERY_BLOCK = 1024
# Vectors that meet a block of queries at once; their scores are held several times over.
VECTOR_BLOCK = 2048
SLICE_ROWS = 1 << 14


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row-wise indices of the k best by (rounded score desc, id asc)."""
    order = np.argsort(ids, kind="stable")
    ranked = np.argsort(-np.round(scores[:, order], SCORE_DIGITS), axis=1, kind="stable")[:, :k]
    return order[ranked]


def cosine_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = RETRIEVAL_TOP_K, max_queries: int = QUERY_BLOCK
) -> DataFrame:
    """Exact top ``k`` by cosine: query_id, chunk_id, score, rank.

    ``queries``: query_id, vector; ``vectors``: chunk_id, vector.  A block of
    queries is multiplied with each Arrow batch and only its k best leave the
    task, so pairs are never emitted.  More queries than one block are cut into
    blocks that meet the vectors slice by slice, each slice being one bounded
    group.
    """
    qid, cid = queries.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    schema = f"query_id {qid.simpleString()}, chunk_id {cid.simpleString()}, score double"
    n = queries.count()
    if n <= max_queries:
        local = queries.toPandas()  # at most one block of queries
        q_ids = local["query_id"].to_numpy()
        q_unit = _unit(_matrix(local["vector"])) if n else np.zeros((0, 1))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # The best so far is carried from batch to batch and leaves the task once.
            held: pd.DataFrame | None = None
            for frame in batches:
                for cut in range(0, len(frame) if len(q_ids) else 0, VECTOR_BLOCK):
                    held = _merge_best(held, _block_best(q_ids, q_unit, frame[cut : cut + VECTOR_BLOCK], k), k)
            if held is not None:
                yield held

        best = vectors.select("chunk_id", "vector").mapInPandas(partial, schema)
        return top_k(best, k)

    blocks = -(-n // max_queries)
    slices = max(1, -(-vectors.count() // SLICE_ROWS))
    bucket = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select("query_id", "vector", bucket("query_id", blocks).alias("_b"), each(slices).alias("_s"))
    right = vectors.select("chunk_id", "vector", each(blocks).alias("_b"), bucket("chunk_id", slices).alias("_s"))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame(columns=["query_id", "chunk_id", "score"])
        return _block_best(q["query_id"].to_numpy(), _unit(_matrix(q["vector"])), v, k)

    best = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(meet, schema)
    return top_k(best, k)


def _merge_best(held: pd.DataFrame | None, new: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query in both frames, by (rounded score desc, id asc)."""
    both = new if held is None else pd.concat([held, new], ignore_index=True)
    both = both.assign(_s=-np.round(both["score"], SCORE_DIGITS)).sort_values(["query_id", "_s", "chunk_id"], kind="stable")
    return both.groupby("query_id", sort=False).head(k).drop(columns="_s")


def _block_best(q_ids: np.ndarray, q_unit: np.ndarray, frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ids = frame["chunk_id"].to_numpy()
    scores = q_unit @ _unit(_matrix(frame["vector"])).T
    chosen = _best(scores, ids, k)
    width = chosen.shape[1]
    return pd.DataFrame(
        {
            "query_id": np.repeat(q_ids, width),
            "chunk_id": ids[chosen.ravel()],
            "score": np.take_along_axis(scores, chosen, axis=1).ravel(),
        }
    )


# --- latent vectors ---------------------------------------------------------

# Terms share so many hashed columns, so the basis is bounded whatever the vocabulary.
COLUMNS = 1 << 16


@dataclass(frozen=True)
class LatentSpace:
    """Right singular vectors of the hashed TF-IDF matrix, and the weights they stand on."""

    idf: DenseVector
    basis: np.ndarray  # columns x components


def _hashed(texts: DataFrame, columns: int) -> DataFrame:
    """``texts`` (key, text) with the term counts of each text in a sparse vector."""
    split = texts.withColumn("_terms", retrieval_terms(F.coalesce("text", F.lit(""))))
    return HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=columns).transform(split).drop("_terms", "text")


def _weighted(counted: DataFrame, idf: DenseVector) -> DataFrame:
    """Unit TF-IDF vectors ``_u``."""
    weights = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w").transform(counted)
    return Normalizer(inputCol="_w", outputCol="_u").transform(weights).drop("_tf", "_w")


def fit_latent(chunks: DataFrame, components: int = 50, columns: int = COLUMNS) -> LatentSpace:
    """Truncated SVD of the TF-IDF matrix of ``chunks`` (chunk_id, text) by Spark's decomposition.

    Components are bounded by the columns in use - 1 and chunks - 1.
    """
    counted = materialise(_hashed(chunks.select("chunk_id", "text"), columns))
    if counted.isEmpty():
        return LatentSpace(DenseVector(np.ones(columns)), np.zeros((columns, 1)))
    fitted = IDF(inputCol="_tf", outputCol="_w").fit(counted)
    # Spark's idf is ln((1+n)/(1+df)); the retrieval weights add one.
    idf = DenseVector(fitted.idf.toArray() + 1.0)
    used, n_chunks = int((np.asarray(fitted.docFreq) > 0).sum()), int(fitted.numDocs)
    wanted = min(components, used - 1, n_chunks - 1)
    if wanted < 1:
        return LatentSpace(idf, np.zeros((columns, 1)))
    # Read by every step of the decomposition, so weighted once and kept, beside the heap:
    # a large matrix would fill it.  No row passes Python.
    rows = MLUtils.convertVectorColumnsFromML(_weighted(counted, idf).select("_u"), "_u").persist(StorageLevel.DISK_ONLY)
    try:
        basis = RowMatrix(rows, n_chunks, columns).computeSVD(wanted).V.toArray()
    finally:
        rows.unpersist()
    return LatentSpace(idf, basis)


def latent_vectors(space: LatentSpace, texts: DataFrame, key: str) -> DataFrame:
    """``key, vector``: texts in the latent space; a text without an indexable term is the zero vector."""
    basis = texts.sparkSession.sparkContext.broadcast(space.basis)

    @F.pandas_udf("array<double>")
    def project(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([v @ basis.value[i] for i, v in zip(indices, values, strict=True)], dtype=object)

    unit = _weighted(_hashed(texts.select(key, "text"), space.basis.shape[0]), space.idf)
    return unit.select(key, F.unwrap_udt("_u").alias("_p")).select(key, project("_p.indices", "_p.values").alias("vector"))


def latent_retrieve(queries: DataFrame, chunks: DataFrame, k: int = RETRIEVAL_TOP_K, components: int = 50) -> DataFrame:
    """Top ``k`` by cosine in the latent space.

    Vectors are written before they are compared: projecting and comparing in one stage
    would hold two Python workers a core."""
    space = fit_latent(chunks, components)
    asked = latent_vectors(space, queries.select("query_id", F.col("query_text").alias("text")), "query_id")
    return cosine_top_k(asked, materialise(latent_vectors(space, chunks, "chunk_id")), k)
