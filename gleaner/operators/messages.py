"""Pruning of marked spans inside messages, for tables of requests.

A message is one row, so everything about a span happens under one key: span
statistics need a single exchange by (message, span) and no message grows with
the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import MARKER_CLOSE, MARKER_OPEN, MESSAGE_PRESET
from gleaner.functions.sections import (
    marked_inner,
    marked_outer,
    sections,
    strip_marked,
    wrap_as_marked,
)
from gleaner.functions.text import bind, count_tokens, retrieval_terms, strip, term_counts
from gleaner.operators import rules
from gleaner.operators.retrieval import SCORE_DIGITS

_SECTION = "struct<heading:string,body:string>"


def rank_and_score(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TF-IDF cosine fitted per set: keys, position, score, rank.

    ``chunks``: keys, position (from 0), text, query_text.  A set without a single
    indexable term scores 1.0 throughout in input order.
    """
    keys = list(keys)

    def entries(position: Column, counts: Column) -> Column:
        return F.transform(
            counts,
            lambda t: F.struct(
                position.alias("_p"), t["term"].alias("term"), t["tf"].cast("double").alias("tf")
            ),
        )

    # The query joins its set as position -1; an empty term keeps chunks that
    # have no indexable term.
    own = entries(F.col("position"), term_counts(retrieval_terms(F.col("text"))))
    placeholder = F.array(
        F.struct(F.col("position").alias("_p"), F.lit("").alias("term"), F.lit(0.0).alias("tf"))
    )
    asked = F.when(
        F.col("position") == 0,
        entries(F.lit(-1), term_counts(retrieval_terms(F.col("query_text")))),
    ).otherwise(F.expr("cast(array() as array<struct<_p:int,term:string,tf:double>>)"))
    # Counted where the text is: what moves is the counts, once for every grouping below.
    pairs = (
        chunks.select(*keys, F.concat(own, placeholder, asked).alias("_e"))
        .repartition(*keys)
        .select(*keys, F.inline_outer("_e"))
    )
    in_set = Window.partitionBy(*keys)
    same_term = Window.partitionBy(*keys, "term")
    is_chunk = F.col("_p") >= 0
    counted = pairs.select(
        *keys,
        "_p",
        "term",
        "tf",
        F.count(F.when(is_chunk & (F.col("term") == ""), 1)).over(in_set).alias("_n"),
        F.count(F.when(is_chunk & (F.col("term") != ""), 1)).over(in_set).alias("_v"),
        F.count(F.when(is_chunk, 1)).over(same_term).alias("_df"),
        F.coalesce(F.max(F.when(~is_chunk, F.col("tf"))).over(same_term), F.lit(0.0)).alias("_qtf"),
    )
    idf = F.when(
        (F.col("term") != "") & (F.col("_df") > 0),
        F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1,
    ).otherwise(F.lit(0.0))
    sums = (
        counted.withColumn("_idf", idf)
        .groupBy(*keys, "_p")
        .agg(
            F.sqrt(F.sum(F.col("tf") * F.col("_idf") * F.col("tf") * F.col("_idf"))).alias("_norm"),
            F.sum(F.col("tf") * F.col("_idf") * F.col("_qtf") * F.col("_idf")).alias("_dot"),
            F.max("_v").alias("_v"),
        )
    )
    query_norm = F.max(F.when(F.col("_p") == -1, F.col("_norm"))).over(in_set)
    scored = sums.select(*keys, "_p", "_v", "_norm", "_dot", query_norm.alias("_qn")).filter(is_chunk)
    both = F.col("_norm") * F.coalesce(F.col("_qn"), F.lit(0.0))
    score = (
        F.when(F.col("_v") == 0, F.lit(1.0))
        .when(both > 0, F.col("_dot") / both)
        .otherwise(F.lit(0.0))
    )
    # Ids within a set differ in the position only and compare as strings.
    order = in_set.orderBy(
        F.round("score", SCORE_DIGITS).desc(),
        F.when(F.col("_v") == 0, F.col("position")).otherwise(F.lit(0)),
        F.col("position").cast("string"),
    )
    return (
        scored.select(*keys, F.col("_p").alias("position"), "_v", score.alias("score"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .drop("_v")
    )


def span_sections(inner: Column) -> Column:
    """Sections of one span; text without sections is one section."""
    return bind(
        sections(inner),
        lambda s: F.when(
            (F.size(s) == 0) & (strip(inner) != ""),
            F.array(F.struct(F.lit(None).cast("string").alias("heading"), strip(inner).alias("body"))),
        ).otherwise(s),
    )


def block_chunks(
    messages: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str] = (),
    marker_open: str = MARKER_OPEN,
    marker_close: str = MARKER_CLOSE,
) -> DataFrame:
    """keys, carried columns, block_no, position, heading, text of marked spans."""
    spans = messages.filter(F.contains(F.col("text"), F.lit(marker_open))).select(
        *keys,
        *carry,
        F.posexplode_outer(marked_inner(F.col("text"), marker_open, marker_close)).alias("block_no", "_i"),
    )
    cut = spans.filter(F.col("block_no").isNotNull()).select(
        *keys,
        *carry,
        "block_no",
        F.posexplode_outer(span_sections(F.col("_i"))).alias("position", "_c"),
    )
    return cut.filter(F.col("position").isNotNull()).select(
        *keys,
        *carry,
        "block_no",
        "position",
        F.col("_c.heading").alias("heading"),
        F.col("_c.body").alias("text"),
    )


def block_decisions(
    messages: DataFrame,
    keys: Sequence[str],
    token_count=count_tokens,
    marker_open: str = MARKER_OPEN,
    marker_close: str = MARKER_CLOSE,
) -> DataFrame:
    """Retention decisions for the chunks of every marked span.

    ``messages``: keys, text, query_text, threshold, min_context, token_budget.
    """
    policy = ["threshold", "min_context", "token_budget"]
    chunks = block_chunks(messages, keys, ["query_text", *policy], marker_open, marker_close)
    in_block = [*keys, "block_no"]
    sized = chunks.withColumn("tokens", token_count(F.col("text")))
    # Carried through the scoring as one struct per chunk, so text is left behind.
    facts = sized.select(*in_block, "position", "tokens", *policy)
    scored = rank_and_score(sized.select(*in_block, "position", "text", "query_text"), in_block)
    joined = scored.join(facts, [*in_block, "position"]).withColumn("doc_id", F.col("block_no"))
    return rules.apply_rules(joined, in_block)


def prune_text(
    messages: DataFrame,
    keys: Sequence[str],
    token_count=count_tokens,
    marker_open: str = MARKER_OPEN,
    marker_close: str = MARKER_CLOSE,
) -> DataFrame:
    """All columns of ``messages`` with ``text`` pruned, plus ``tokens_pruned``.

    Kept sections come back in position order joined by a blank line (heading
    lines are not part of a section body); text around spans is unchanged.
    Messages without a marker take no part in any shuffle.
    """
    keys = list(keys)
    marked = F.contains(F.col("text"), F.lit(marker_open))
    plain = messages.filter(~F.coalesce(marked, F.lit(False))).withColumn("tokens_pruned", F.lit(0).cast("long"))
    touched = messages.filter(marked)
    decided = block_decisions(touched, keys, token_count, marker_open, marker_close)
    per_message = (
        decided.groupBy(*keys, "block_no")
        .agg(
            F.collect_list(F.when(F.col("kept"), F.col("position"))).alias("_kept"),
            F.sum(F.when(~F.col("kept"), F.col("tokens")).otherwise(F.lit(0))).alias("_lost"),
        )
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("block_no", "_kept"))).alias("_kept"),
            F.sum("_lost").alias("_lost"),
        )
    )

    def replacement(inner: Column, kept: Column) -> Column:
        bodies = F.filter(span_sections(inner), lambda c, i: F.array_contains(kept, i))
        return F.array_join(F.transform(bodies, lambda c: c["body"]), "\n\n")

    inner = marked_inner(F.col("text"), marker_open, marker_close)
    outer = marked_outer(F.col("text"), marker_open, marker_close)
    rebuilt = bind(
        F.struct(inner.alias("inner"), outer.alias("outer")),
        lambda s: F.array_join(
            F.transform(
                s["outer"],
                lambda o, i: F.concat(
                    o,
                    F.when(
                        i < F.size(s["inner"]),
                        F.coalesce(
                            replacement(F.get(s["inner"], i), F.col("_kept")[i]), F.lit("")
                        ),
                    ).otherwise(F.lit("")),
                ),
            ),
            "",
        ),
    )
    pruned = touched.join(per_message, keys, "left").select(
        *[rebuilt.alias("text") if c == "text" else F.col(c) for c in messages.columns],
        F.coalesce("_lost", F.lit(0)).cast("long").alias("tokens_pruned"),
    )
    return plain.unionByName(pruned)


def chat_query(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, query_text``: the last user message with string content, spans
    stripped; an empty query where there is none."""
    is_user = (F.col("role") == "user") & F.col("text").isNotNull()
    last = messages.groupBy(key).agg(
        F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("_t")
    )
    return last.select(key, F.coalesce(strip_marked(F.col("_t")), F.lit("")).alias("query_text"))


def prune_chat(
    messages: DataFrame,
    key: str = "conv_id",
    preset: str = MESSAGE_PRESET,
    auto_mark_tool_results: bool = False,
    system: DataFrame | None = None,
) -> DataFrame:
    """Prune the string messages of every chat.

    ``messages``: key, turn, role, text.  ``system`` (key, text) is pruned like a
    message and comes back as turn -1.  With auto-mark on, messages of role
    ``tool`` count as one span.
    """
    query = chat_query(messages, key)
    everything = messages.select(key, "turn", "role", "text")
    if system is not None:
        everything = everything.unionByName(
            system.select(key, F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text")
        )
    if auto_mark_tool_results:
        everything = everything.withColumn(
            "text",
            F.when(F.col("role") == "tool", wrap_as_marked(F.col("text"))).otherwise(F.col("text")),
        )
    # A request may hold a system field only; its query is empty.
    asked = everything.join(query, key, "left").withColumn("query_text", F.coalesce("query_text", F.lit("")))
    ready = rules.with_preset(asked, preset)
    return prune_text(ready, [key, "turn"]).select(key, "turn", "role", "text", "tokens_pruned")


def request_totals(pruned: DataFrame, key: str = "conv_id") -> DataFrame:
    return pruned.groupBy(key).agg(F.sum("tokens_pruned").alias("tokens_pruned"))


# --- content given as a list of blocks -------------------------------------

_BLOCKS = "array<variant>"


def _field(block: Column, name: str) -> Column:
    return F.try_variant_get(block, f"$.{name}", "string")


def _typed(block: Column, name: str) -> Column:
    """A field only when it holds a JSON string (not a number or an object)."""
    is_string = F.schema_of_variant(F.try_variant_get(block, f"$.{name}", "variant")) == "STRING"
    return F.when(is_string, _field(block, name))


def parse_blocks(content: Column) -> Column:
    """Blocks of a JSON list, null for anything else."""
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, _BLOCKS))


def _as_text(content: Column) -> Column:
    """The text of content given as a JSON string, null for anything else."""
    is_string = F.startswith(F.ltrim(content), F.lit('"'))
    return F.when(is_string, F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v"))


def block_query(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Query of block-style requests: the last user message, whatever it holds.

    Text blocks are joined by newlines; a last user turn of tool results only
    gives an empty query."""
    is_user = F.col("role") == "user"
    last = messages.groupBy(key).agg(
        F.max_by(F.when(is_user, F.col("content")), F.when(is_user, F.col("turn"))).alias("_c")
    )
    from_blocks = F.array_join(
        F.transform(
            F.filter(parse_blocks(F.col("_c")), lambda b: _field(b, "type") == "text"),
            lambda b: F.coalesce(_field(b, "text"), F.lit("")),
        ),
        "\n",
    )
    text = F.coalesce(_as_text(F.col("_c")), from_blocks, F.lit(""))
    return last.select(key, strip_marked(text).alias("query_text"))


def _leaves(messages: DataFrame, keys: Sequence[str], auto_mark: bool) -> DataFrame:
    """Prunable texts: keys, part_no, sub_no, text (-1 where a level is absent)."""
    whole = messages.select(
        *keys, F.lit(-1).alias("part_no"), F.lit(-1).alias("sub_no"), _as_text(F.col("content")).alias("text")
    )
    blocks = messages.select(
        *keys, F.posexplode_outer(parse_blocks(F.col("content"))).alias("part_no", "_b")
    ).filter(F.col("part_no").isNotNull())
    text = blocks.filter(_field(F.col("_b"), "type") == "text").select(
        *keys, "part_no", F.lit(-1).alias("sub_no"), _typed(F.col("_b"), "text").alias("text")
    )
    leaves = whole.unionByName(text)
    if auto_mark:
        results = blocks.filter(_field(F.col("_b"), "type") == "tool_result")
        direct = results.select(
            *keys,
            "part_no",
            F.lit(-1).alias("sub_no"),
            wrap_as_marked(_typed(F.col("_b"), "content")).alias("text"),
        )
        nested = results.select(
            *keys,
            "part_no",
            F.posexplode_outer(F.try_variant_get(F.col("_b"), "$.content", _BLOCKS)).alias("sub_no", "_s"),
        ).filter(F.col("sub_no").isNotNull() & (_field(F.col("_s"), "type") == "text"))
        leaves = leaves.unionByName(direct).unionByName(
            nested.select(*keys, "part_no", "sub_no", wrap_as_marked(_typed(F.col("_s"), "text")).alias("text"))
        )
    return leaves.filter(F.col("text").isNotNull())


def _with_field(block: Column, name: str, value: Column) -> Column:
    """The block with one field replaced; other fields and their order stay."""
    return F.transform_values(
        block.cast("map<string,variant>"),
        lambda k, v: F.when(k == name, value.cast("variant")).otherwise(v),
    )


def prune_block_messages(
    messages: DataFrame,
    key: str = "conv_id",
    preset: str = MESSAGE_PRESET,
    auto_mark_tool_results: bool = False,
    system: DataFrame | None = None,
) -> DataFrame:
    """Prune messages whose ``content`` is a JSON string or a JSON block list.

    ``messages``: key, turn, role, content (JSON).  Only text blocks are touched,
    and tool results when auto-mark is on; other blocks keep their fields.
    """
    query = block_query(messages, key)
    everything = messages.select(key, "turn", "role", "content")
    if system is not None:
        everything = everything.unionByName(
            system.select(
                key, F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "content"
            )
        )
    keys = [key, "turn"]
    leaves = _leaves(everything, keys, auto_mark_tool_results).join(query, key, "left")
    leaves = leaves.withColumn("query_text", F.coalesce("query_text", F.lit("")))
    pruned = prune_text(rules.with_preset(leaves, preset), [*keys, "part_no", "sub_no"])
    new = pruned.groupBy(*keys).agg(
        F.collect_list(F.struct("part_no", "sub_no", "text")).alias("_new"),
        F.sum("tokens_pruned").alias("tokens_pruned"),
    )

    def replaced(part_no: Column, sub_no: Column) -> Column:
        same = F.filter("_new", lambda x: (x["part_no"] == part_no) & (x["sub_no"] == sub_no))
        return F.get(F.transform(same, lambda x: x["text"]), F.lit(0))

    def rebuild_sub(block: Column, j: Column) -> Column:
        subs = F.try_variant_get(block, "$.content", _BLOCKS)
        return F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    subs,
                    lambda s, k: F.when(
                        replaced(j, k).isNotNull(), F.to_json(_with_field(s, "text", replaced(j, k)))
                    ).otherwise(F.to_json(s)),
                ),
                ",",
            ),
            F.lit("]"),
        )

    def rebuild(block: Column, j: Column) -> Column:
        is_text = _field(block, "type") == "text"
        own = replaced(j, F.lit(-1))
        has_sub = F.exists("_new", lambda x: (x["part_no"] == j) & (x["sub_no"] >= 0))
        return (
            F.when(own.isNotNull() & is_text, F.to_json(_with_field(block, "text", own)))
            .when(own.isNotNull(), F.to_json(_with_field(block, "content", own)))
            .when(
                has_sub, F.to_json(_with_field(block, "content", F.parse_json(rebuild_sub(block, j))))
            )
            .otherwise(F.to_json(block))
        )

    blocks = parse_blocks(F.col("content"))
    as_list = F.concat(F.lit("["), F.array_join(F.transform(blocks, rebuild), ","), F.lit("]"))
    as_string = F.to_json(replaced(F.lit(-1), F.lit(-1)).cast("variant"))
    content = (
        F.when(F.col("_new").isNull(), F.col("content"))
        .when(F.startswith(F.ltrim(F.col("content")), F.lit("[")), as_list)
        .otherwise(as_string)
    )
    return everything.join(new, keys, "left").select(
        key,
        "turn",
        "role",
        content.alias("content"),
        F.coalesce("tokens_pruned", F.lit(0)).cast("long").alias("tokens_pruned"),
    )
