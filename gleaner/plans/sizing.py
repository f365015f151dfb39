"""Broadcasts behind a size check, and tables that cut the lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A hinted broadcast side never exceeds these; beyond, the shuffle plan is used.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse.

    It has to be shared by driver and executors, so that a written table survives the
    loss of an executor.  A warehouse on a local disk is shared only while everything
    runs in one process; a session on a cluster without a named folder raises.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(warehouse)
        local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("no shared folder: name one in spark.checkpoint.dir")
        named = f"{warehouse}/_scratch"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    Unlike a checkpointed RDD the table is read by column, knows its size, and
    counts from its footers.  It belongs to the session and goes when that ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame,
    *text_columns: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure ``df`` (cheap for base tables and materialised results).

    A row is charged 64 bytes plus its text columns.
    """
    text_bytes = F.lit(0)
    for name in text_columns:
        text_bytes = text_bytes + F.coalesce(F.octet_length(name), F.lit(0))
    row = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(text_bytes), F.lit(0)).alias("b")
    ).first()
    return row["n"] <= max_rows and row["n"] * 64 + row["b"] <= max_bytes


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """Give an input of few splits one partition per core.

    A table kept in one row group would otherwise be parsed by a single task.
    Real tables have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
