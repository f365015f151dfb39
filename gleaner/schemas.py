"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_IN_DOCUMENT = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("doc_chunk_count", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("chunks", T.ArrayType(CHUNK_IN_DOCUMENT)),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question_text", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("relevant", T.BooleanType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("display_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

RATE = T.StructType(
    [
        T.StructField("input_per_million", T.DoubleType()),
        T.StructField("output_per_million", T.DoubleType()),
    ]
)

PRICING = T.StructType(
    [
        T.StructField("pricing_version", T.StringType()),
        T.StructField(
            "providers",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("models", T.MapType(T.StringType(), RATE)),
                    ]
                ),
            ),
        ),
    ]
)

CHUNK_COLUMNS = (
    "doc_id",
    "chunk_id",
    "text",
    "source_type",
    "doc_title",
    "heading",
    "position",
    "doc_chunk_count",
)
