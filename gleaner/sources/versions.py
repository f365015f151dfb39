"""Numbered versions of a folder: taken by one writer each, there once their marker is written."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from gleaner.sources.files import exists, hadoop_path, list_names

# Written into a version last: without it the version is not there.
MARKER = "_PUBLISHED"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Version numbers in use, finished or not; compared as numbers, so v10 follows v9."""
    return sorted(int(m.group(1)) for n in list_names(spark, folder) if (m := re.fullmatch(r"v(\d+)", n)))


def is_published(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{MARKER}")


def mark_published(spark: SparkSession, path: str) -> None:
    fs, marker = hadoop_path(spark, f"{path}/{MARKER}")
    fs.create(marker, True).close()


def published_versions(spark: SparkSession, folder: str) -> list[str]:
    """Finished versions in order; one that was never finished is passed over."""
    return [path for n in _numbers(spark, folder) if is_published(spark, path := f"{folder}/v{n}")]


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """Path of the highest finished ``v{n}``."""
    for n in reversed(_numbers(spark, folder)):
        if is_published(spark, f"{folder}/v{n}"):
            return f"{folder}/v{n}"
    return None


def _created(spark: SparkSession, path: str) -> bool:
    """Create a version folder; false if another writer has it already."""
    fs, p = hadoop_path(spark, path)
    jvm = spark._jvm
    if fs.getScheme() == "file":  # creating a local folder is exclusive, creating a local file through Hadoop is not
        files, local = jvm.java.nio.file.Files, jvm.java.io.File(p.toUri().getPath()).toPath()
        none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
        files.createDirectories(local.getParent(), none)
        create = lambda: files.createDirectory(local, none)
    else:
        create = lambda: fs.create(hadoop_path(spark, f"{path}/_CLAIMED")[1], False).close()
    try:
        create()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def allocate_next_version(spark: SparkSession, folder: str) -> str:
    """Take the next number: its folder is created by this call and by no other."""
    n = max(_numbers(spark, folder), default=0) + 1
    while not _created(spark, f"{folder}/v{n}"):
        n += 1
    return f"{folder}/v{n}"
