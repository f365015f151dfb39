"""Chunks, questions, evidence and messages derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import MARKER_CLOSE, MARKER_OPEN
from gleaner.functions.sections import infer_source_type, sections, wrap_as_marked
from gleaner.functions.text import split_sentences
from gleaner.plans.sizing import broadcast_if, fits_broadcast, spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows cost parsing time, spread over the cores."""
    return spread(table(spark, sf_dir, name, *columns))


def document_chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Every document cut into paragraphs (its lines); the title is its first line.

    With ``of``, rows with a ``chunk_id``, only their documents are cut."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    if of is not None:
        wanted = of.select(F.substring_index("chunk_id", "::c", 1).cast("long").alias("doc_id")).distinct()
        docs = docs.join(broadcast_if(fits_broadcast(wanted), wanted), "doc_id", "left_semi")
    docs = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("lang").alias("doc_type"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("doc_title"),
        sections(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("_s"),
    )
    # The outer form: a plain explode makes the optimizer infer a filter on the
    # array and push it down, which would evaluate the sectioning again.
    exploded = docs.select(
        "doc_id",
        "doc_type",
        "doc_title",
        F.size("_s").alias("doc_chunk_count"),
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
        "doc_type",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk is evidence for a question when it holds one of its sentences."""
    asked = (
        questions(spark, sf_dir)
        .select("query_id", F.explode(split_sentences(F.col("query_text"))).alias("sentence"))
        .distinct()
    )
    held = document_chunks(spark, sf_dir).select(
        "doc_id", "chunk_id", F.explode_outer(split_sentences(F.col("text"))).alias("sentence")
    )
    small = fits_broadcast(asked, "sentence")
    return held.join(broadcast_if(small, asked), "sentence").select("query_id", "chunk_id", "doc_id").distinct()


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as headed text: titles and bold paragraphs become headings."""
    html = F.col("html")
    text = F.regexp_replace(html, "<h1>", "\n# ")
    text = F.regexp_replace(text, "<p><b>", "\n## ")
    text = F.regexp_replace(text, "<[^>]*>", "\n")
    return text_table(spark, sf_dir, "pages", "page_id", "html").select("page_id", text.alias("text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which assistant turns play the part of tool results.

    System turns are left out: they are the system field of the request."""
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return (
        text_table(spark, sf_dir, "conversations")
        .filter(F.col("role") != "system")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
            F.when(F.col("role") == "assistant", paragraphs).otherwise(F.col("text")).alias("text"),
        )
    )


def system_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns of a conversation, joined in turn order and marked."""
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_all"))
        .select("conv_id", F.array_join(F.transform("_all", lambda t: t["text"]), "\n").alias("text"))
        .select("conv_id", wrap_as_marked(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("text"))
    )


def marked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its text marked, a blank span and a tail after it."""
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return text_table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat(
            F.lit("Given "), F.lit(MARKER_OPEN), paragraphs, F.lit(MARKER_CLOSE), F.lit(" and "),
            F.lit(MARKER_OPEN), F.lit("  "), F.lit(MARKER_CLOSE), F.lit(" go on. "),
        ).alias("text"),
    )


# What the event types of the log stand for, and the value from which a retry
# counts as improved and an accepted answer as grounded.
FEEDBACK = {
    "view": "regenerate",
    "error": "thumbs_down",
    "signup": "retry",
    "click": "mark_irrelevant",
    "purchase": "accept",
}
GOOD_VALUE = 20.0


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as session feedback: one session per user.

    The number in ``props`` names the rank the event is about."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])[F.col("event_type")]
    good = F.col("value") >= GOOD_VALUE
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "ts",
        "event_id",
        kind.alias("event_type"),
        good.alias("improved"),
        F.array(
            F.concat(F.lit("c"), k.cast("string")), F.concat(F.lit("c"), (k + 1).cast("string"))
        ).alias("cited"),
        F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"),
        good.alias("grounded"),
        "value",
        k.alias("k"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as replay trials: one run per event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    total = F.pmod(k, F.lit(3))
    kept = F.least(total, F.floor(F.col("value") / 10))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("policy"),
        "ts",
        "event_id",
        total.alias("relevant_total"),
        kept.alias("relevant_retained"),
        F.when(total > 0, kept / total).otherwise(F.lit(1.0)).alias("recall"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer = a benchmark passage, asked for by its first sentence."""
    sentences = split_sentences(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("answer_id"),
        F.get(sentences, F.lit(0)).alias("query_text"),
        F.col("text").alias("answer_text"),
    )
