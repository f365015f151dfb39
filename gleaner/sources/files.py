"""Reading corpora, labels, folders of text, splits and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.config import SPLIT_NAMES
from gleaner.functions.sections import infer_source_type, sections
from gleaner.plans.ordering import DEFAULT_SLICES, running, slice_of
from gleaner.plans.sizing import broadcast_if, fits_broadcast

INGESTIBLE = r"(?i)\.(md|markdown|txt)$"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of any URI Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str, directories: bool = True) -> list[str]:
    """Names directly under a path, sorted."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    found = fs.listStatus(p)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() or not directories)


def load_documents(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """One JSON object per file (or per line with ``multi_line=False``); of files
    with the same doc_id the last path wins.  A malformed object raises when read."""
    raw = (
        spark.read.schema(schemas.DOCUMENT)
        .json(folder, multiLine=multi_line, mode="FAILFAST")
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    last = raw.groupBy("doc_id").agg(F.max("_path").alias("_path"))
    return raw.join(last, ["doc_id", "_path"]).drop("_path")


def load_all_chunks(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Chunks of all documents, the title copied onto each."""
    return load_documents(spark, folder, multi_line).select(
        "doc_id", "title", "doc_type", F.inline("chunks")
    ).select(
        "doc_id", "chunk_id", "text", "source_type", F.col("title").alias("doc_title"),
        "heading", "position", "doc_chunk_count", "doc_type",
    )


def load_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Relevant label rows of a JSON-lines file, blank lines skipped.

    A malformed line raises when read."""
    rows = spark.read.schema(schemas.LABEL).json(path, mode="FAILFAST")
    return rows.filter(F.col("question_id").isNotNull() & F.coalesce("relevant", F.lit(False)))


def load_question_labels(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question_text, relevant_chunk_ids, relevant_doc_ids.

    The first text of a question wins, by file and place in it; a question without a
    relevant row does not appear."""
    # Within a file the blocks and their rows are numbered in order.
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return (
        load_label_rows(spark, path)
        .withColumn("_line", line)
        .groupBy("question_id")
        .agg(
            F.min_by("question_text", "_line").alias("question_text"),
            F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"),
            F.array_sort(F.collect_set("doc_id")).alias("relevant_doc_ids"),
        )
    )


def evidence(labels: DataFrame) -> DataFrame:
    """Normalised (query_id, chunk_id, doc_id) pairs of label rows."""
    return labels.select(F.col("question_id").alias("query_id"), "chunk_id", "doc_id").distinct()


def chunk_local_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk every .md/.markdown/.txt file under a folder.

    Documents are numbered over the sorted path list; text takes no part in that
    ordering.  Raises for a missing folder or one without such files.
    """
    if not exists(spark, folder):
        raise ValueError(f"not a directory: {folder}")
    fs, p = hadoop_path(spark, folder)
    if not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"not a directory: {folder}")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .filter(F.col("path").rlike(INGESTIBLE))
    )
    paths = files.select("path")
    if paths.isEmpty():
        raise ValueError(f"no .md/.markdown/.txt files found under {folder}")
    numbered = number_paths(paths)
    small = fits_broadcast(paths, "path")
    # Undecodable bytes are dropped: they become replacement marks, which go.
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    decoded = F.when(valid, raw).otherwise(F.translate(F.make_valid_utf8(raw), "\ufffd", ""))
    docs = files.join(broadcast_if(small, numbered), "path").select(
        "doc_id", "doc_title", sections(decoded).alias("_s")
    )
    exploded = docs.select(
        "doc_id", "doc_title", F.size("_s").alias("doc_chunk_count"),
        F.posexplode_outer("_s").alias("position", "_c"),
    ).filter(F.col("position").isNotNull())
    return exploded.select(
        "doc_id",
        F.concat("doc_id", F.lit("::c"), F.col("position").cast("string")).alias("chunk_id"),
        F.col("_c.body").alias("text"),
        infer_source_type(F.col("_c.body")).alias("source_type"),
        "doc_title",
        F.col("_c.heading").alias("heading"),
        "position",
        "doc_chunk_count",
    )


def number_paths(paths: DataFrame, slices: int = DEFAULT_SLICES) -> DataFrame:
    """path, doc_id, doc_title with ``adhoc-{index:03d}-{stem}`` ids.

    Paths sort component by component.  The list is cut by its range-partitioned
    order and counted per slice, so a large tree is not ordered in one task.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.when(
        name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")
    ).otherwise(name)
    # A separator below every printable character makes string order equal to
    # component order.
    placed = paths.select("path", stem.alias("doc_title"), F.translate("path", "/", "\u0001").alias("_key"))
    cuts = _path_bounds(placed, slices)
    ranked = running(
        placed.withColumn("_slice", slice_of(F.col("_key"), cuts)).withColumn("_all", F.lit(0)),
        ["_all"], "_slice", [F.col("_key")], {"_i": F.lit(1)},
    )
    return ranked.select(
        "path",
        "doc_title",
        F.format_string("adhoc-%03d-%s", (F.col("_i") - 1).cast("int"), F.col("doc_title")).alias("doc_id"),
    )


def _path_bounds(placed: DataFrame, slices: int) -> list[str]:
    """Cut points of the path order from a bounded set of paths.

    The paths with the smallest md5 are an even sample; bounds steer balance
    only, the ordinals are exact whatever they are."""
    sample = [r["_key"] for r in placed.select("_key").orderBy(F.md5("_key")).limit(slices * 20).collect()]
    ordered = sorted(sample, key=lambda x: x.encode())
    return sorted({ordered[i * len(ordered) // slices] for i in range(1, slices)}, key=lambda x: x.encode()) if ordered else []


def load_pricing(spark: SparkSession, path: str) -> DataFrame:
    """provider, model, input_per_million, output_per_million, pricing_version."""
    raw = spark.read.schema(schemas.PRICING).json(path, multiLine=True)
    providers = raw.select("pricing_version", F.explode("providers").alias("provider", "_p"))
    models = providers.select(
        "pricing_version", "provider", F.explode("_p.models").alias("model", "_r")
    )
    return models.select("provider", "model", "_r.*", "pricing_version")


def load_splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(document splits, question splits) as written by ``persist_splits``."""
    docs = spark.read.parquet(f"{folder}/documents")
    asked = spark.read.parquet(f"{folder}/questions").withColumn(
        "split", F.when(F.col("split").isin(*SPLIT_NAMES), F.col("split"))
    )
    return docs, asked
