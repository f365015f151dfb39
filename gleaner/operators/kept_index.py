"""A TF-IDF index of a corpus that is kept between queries.

The index is a folder of segments and versions.  A segment holds the counted terms of one
batch of chunks, their postings in buckets of terms, and its document frequencies; it is never changed.
A version sums the frequencies of all segments and holds the norms that follow from
them, so a query reads the buckets of its own terms and no text, and adding chunks
reads no text but theirs.  Segments and versions count only with their marker, which is
written last; numbers are taken by one writer each.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import RETRIEVAL_TOP_K
from gleaner.operators import retrieval
from gleaner.plans.sizing import fits_broadcast
from gleaner.sources.files import hadoop_path
from gleaner.sources.versions import allocate_next_version, latest_version, mark_published, published_versions

BUCKETS = 256
# Chunk numbers: the segment, then the place in it.
SEGMENT_BITS = 53
MAX_SEGMENTS = 1 << (63 - SEGMENT_BITS)


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class KeptPostings(retrieval.Postings):
    """Postings in buckets of terms, with stored norms."""

    by_term: DataFrame  # bucket, term, chunk_no, tf
    stored_norms: DataFrame  # chunk_no, norm
    about: dict

    @property
    def rows(self) -> DataFrame:
        return self.by_term.drop("bucket")

    @property
    def norms(self) -> DataFrame:
        return self.stored_norms

    @property
    def reads_by_term(self) -> bool:
        return True

    def rows_for(self, asked: DataFrame) -> DataFrame:
        """Only the buckets that hold an asked term (at most ``BUCKETS`` numbers reach the driver)."""
        wanted = [r["b"] for r in asked.select(_bucket().alias("b")).distinct().collect()]
        return self.by_term.filter(F.col("bucket").isin(wanted)).drop("bucket")


def create(spark: SparkSession, folder: str, owner: str, days: int | None = None) -> None:
    """An empty index that belongs to ``owner`` and expires after ``days``."""
    until = (dt.datetime.now(dt.UTC) + dt.timedelta(days=days)).isoformat() if days is not None else None
    row = spark.createDataFrame([(json.dumps({"owner": owner, "expires": until}),)], "value string")
    row.coalesce(1).write.text(f"{folder}/about")


def add(chunks: DataFrame, folder: str) -> str:
    """Index ``chunks`` (chunk_id, text) beside those already there; returns the new version.

    Chunk ids must be new to the index.  Ranks are those of an index of all chunks at once.
    """
    spark = chunks.sparkSession
    segment = allocate_next_version(spark, f"{folder}/segments")
    number = int(segment.rsplit("v", 1)[1])
    if number >= MAX_SEGMENTS:
        raise ValueError(f"an index has at most {MAX_SEGMENTS - 1} segments: build it anew")

    def keep(counted: DataFrame) -> DataFrame:
        counted.withColumn("chunk_no", F.lit(number << SEGMENT_BITS) + F.col("chunk_no")).write.parquet(f"{segment}/counted")
        return _counted(spark, [segment])

    counted = retrieval.count_terms(chunks, write=keep)
    posted = counted.select("chunk_no", F.inline_outer("terms")).filter(F.col("term").isNotNull())
    (
        posted.withColumn("bucket", _bucket())
        # A term of very many chunks is dealt over several files of its bucket.
        .repartition("bucket", F.pmod(F.xxhash64("chunk_no"), F.lit(max(1, spark.sparkContext.defaultParallelism // 4))))
        .sortWithinPartitions("bucket", "term", "chunk_no")
        .write.partitionBy("bucket").parquet(f"{segment}/postings")
    )
    spark.read.schema("term string, chunk_no long, tf int, bucket int").parquet(f"{segment}/postings").groupBy("term").agg(
        F.count("*").alias("df")
    ).write.parquet(f"{segment}/frequencies")
    mark_published(spark, segment)
    return _new_version(spark, folder)


def _new_version(spark: SparkSession, folder: str) -> str:
    """Frequencies and norms over all finished segments."""
    version = allocate_next_version(spark, f"{folder}/versions")
    # Listed after the number is taken: a later number never knows fewer segments.
    segments = published_versions(spark, f"{folder}/segments")
    df = spark.read.schema("term string, df long").parquet(*[f"{s}/frequencies" for s in segments])
    counted = _counted(spark, segments)
    n = counted.count()
    terms = df.groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    terms.write.parquet(f"{version}/terms")
    row = spark.createDataFrame([(json.dumps({"segments": segments, "chunks": n}),)], "value string")
    row.coalesce(1).write.text(f"{version}/manifest")
    vocabulary = spark.read.schema("term string, df long, idf double").parquet(f"{version}/terms")
    # From whole chunks: the weights of a chunk are summed before they move.
    retrieval.Postings(counted, _model(vocabulary)).norms.write.parquet(f"{version}/norms")
    mark_published(spark, version)
    return version


def _model(vocabulary: DataFrame) -> retrieval.TfidfModel:
    return retrieval.TfidfModel(vocabulary, (), fits_broadcast(vocabulary, "term"), 100_000)


def _counted(spark: SparkSession, segments: Sequence[str]) -> DataFrame:
    return spark.read.schema("chunk_no long, chunk_id string, terms array<struct<term:string,tf:int>>").parquet(*[f"{s}/counted" for s in segments])


def _postings(spark: SparkSession, segments: Sequence[str]) -> DataFrame:
    parts = [
        spark.read.schema("term string, chunk_no long, tf int, bucket int").parquet(f"{s}/postings") for s in segments
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def load(spark: SparkSession, folder: str) -> KeptPostings:
    """The latest version; raises if there is none or the index has expired."""
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    if about["expires"] and dt.datetime.fromisoformat(about["expires"]) < dt.datetime.now(dt.UTC):
        raise ValueError(f"the index in {folder} expired on {about['expires']}")
    version = latest_version(spark, f"{folder}/versions")
    if version is None:
        raise ValueError(f"nothing is indexed in {folder}")
    manifest = json.loads(spark.read.text(f"{version}/manifest").first()["value"])
    vocabulary = spark.read.schema("term string, df long, idf double").parquet(f"{version}/terms")
    return KeptPostings(
        chunks=_counted(spark, manifest["segments"]),
        model=_model(vocabulary),
        by_term=_postings(spark, manifest["segments"]),
        stored_norms=spark.read.schema("chunk_no long, norm double").parquet(f"{version}/norms"),
        about=about | manifest,
    )


def retrieve(spark: SparkSession, queries: DataFrame, folder: str, k: int = RETRIEVAL_TOP_K) -> DataFrame:
    """As :func:`retrieval.retrieve`, from the kept index."""
    return retrieval.retrieve(queries, load(spark, folder), k)


def drop(spark: SparkSession, folder: str, owner: str) -> None:
    """Remove an index; only its owner may."""
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    if about["owner"] != owner:
        raise PermissionError(f"the index in {folder} belongs to {about['owner']}")
    fs, path = hadoop_path(spark, folder)
    fs.delete(path, True)
