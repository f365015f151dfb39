"""Retention rules under a token budget, and the totals they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import BOUNDARY_MARGIN, DEFAULT_PRESET, PRESETS

POLICY_COLUMNS = ("preset_name", "threshold", "min_context", "token_budget")


# Of a set without scores whose rows do not say why.
UNEXPLAINED = "scoring failed"


def presets(spark: SparkSession) -> DataFrame:
    """The three presets as a fixed dimension table."""
    return spark.createDataFrame(
        [(n, *v) for n, v in PRESETS.items()],
        "preset_name string, threshold double, min_context int, token_budget int",
    )


def with_preset(df: DataFrame, preset: str = DEFAULT_PRESET) -> DataFrame:
    """Attach a preset by name; an unknown name means the default preset."""
    name = preset if preset in PRESETS else DEFAULT_PRESET
    return with_policy(df, *PRESETS[name], preset_name=name)


def with_policy(
    df: DataFrame, threshold: float, min_context: int, token_budget: int, preset_name: str = "custom"
) -> DataFrame:
    """Attach one policy to every row."""
    return df.withColumns(
        {
            "preset_name": F.lit(preset_name),
            "threshold": F.lit(float(threshold)),
            "min_context": F.lit(min_context),
            "token_budget": F.lit(token_budget),
        }
    )


def with_named_policy(df: DataFrame, name: str = "preset") -> DataFrame:
    """Look the policy up by the name in column ``name``; unknown names get the
    default preset."""
    table = F.broadcast(presets(df.sparkSession))  # three rows, fixed
    known = F.create_map(*[F.lit(x) for n in PRESETS for x in (n, n)])
    return (
        df.withColumn("preset_name", F.coalesce(known[F.col(name)], F.lit(DEFAULT_PRESET)))
        .join(table, "preset_name")
    )


def apply_rules(scored: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``scored``: keys, chunk_id, doc_id, position, rank, score, tokens and the
    policy columns, one row per ranked chunk; carry no text through here.

    Adds ``kept, reasons, safety_override, borderline, budget_conflict``.  A set
    with any null score is not pruned at all (see ``pruning_enabled``).
    """
    whole = Window.partitionBy(*keys)
    beside = Window.partitionBy(*keys, "doc_id").orderBy("position")
    in_order = Window.partitionBy(*keys).orderBy("rank")

    enabled = F.count(F.when(F.col("score").isNull(), 1)).over(whole) == 0
    clears = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    near = F.coalesce(
        (F.col("score") >= F.col("threshold") - F.lit(BOUNDARY_MARGIN))
        & (F.col("score") < F.col("threshold")),
        F.lit(False),
    )
    step1 = scored.select(
        "*", enabled.alias("pruning_enabled"), clears.alias("_trigger"), near.alias("_near")
    )
    by_trigger = F.coalesce(
        F.max("_trigger").over(beside.rangeBetween(-1, -1)), F.lit(False)
    ) | F.coalesce(F.max("_trigger").over(beside.rangeBetween(1, 1)), F.lit(False))
    step2 = step1.select(
        "*",
        F.when(F.col("rank") == 0, "top_ranked_result")
        .when(F.col("_trigger"), "above_threshold")
        .when(F.col("_near"), "boundary_buffer")
        .when(by_trigger, "neighbor_preservation")
        .alias("_rule"),
    )
    unwanted = F.col("_rule").isNull()
    deficit = F.col("min_context") - F.count("_rule").over(whole)
    nth_unwanted = F.count(F.when(unwanted, 1)).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    step3 = step2.select(
        *[c for c in step2.columns if c not in ("_rule", "_trigger", "_near")],
        F.when(unwanted & (nth_unwanted <= deficit), "min_context")
        .otherwise(F.col("_rule"))
        .alias("_rule"),
    )
    return _pack(step3, keys)


def _pack(wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy packing in rank order: a chunk that does not fit is skipped and
    later ones may still fit, so this is a fold, not a running sum.

    Each set is one array (k entries, or the chunks of one message); the fold
    appends only ranks that are kept, of which a budget admits few.
    """
    payload = [c for c in wanted.columns if c not in keys]
    sets = wanted.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in payload if c != "rank"]))).alias("_items")
    )
    mandatory = lambda x: x["_rule"].isin("top_ranked_result", "min_context")
    start = F.expr(
        "named_struct('used', 0L, 'kept', cast(array() as array<int>),"
        " 'over', cast(array() as array<int>))"
    )

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["tokens"].cast("long")
        fits = used <= (F.col("token_budget") if "token_budget" in keys else x["token_budget"])
        must = mandatory(x)
        taken = F.struct(
            used.alias("used"),
            F.concat(acc["kept"], F.array(x["rank"].cast("int"))).alias("kept"),
            F.when(must & ~fits, F.concat(acc["over"], F.array(x["rank"].cast("int"))))
            .otherwise(acc["over"])
            .alias("over"),
        )
        return F.when(x["_rule"].isNotNull() & (fits | must), taken).otherwise(acc)

    folded = sets.withColumn("_fold", F.aggregate("_items", start, step))

    def decide(x: Column) -> Column:
        on = x["pruning_enabled"]
        kept = ~on | F.array_contains(F.col("_fold.kept"), x["rank"].cast("int"))
        over = on & F.array_contains(F.col("_fold.over"), x["rank"].cast("int"))
        rule = x["_rule"]
        reasons = (
            F.when(~on, F.array(F.lit("pruning_disabled")))
            .when(over, F.array(rule, F.lit("budget_conflict")))
            .when(kept, F.array(rule))
            .when(rule.isNotNull(), F.array(F.lit("budget_exceeded")))
            .otherwise(F.array(F.lit("below_threshold")))
        )
        override = F.when(~on, F.lit("fallback_unpruned")).when(
            kept & (rule != "above_threshold"), rule
        )
        return F.struct(
            *[
                F.when(on, x["score"]).alias("score") if c == "score" else x[c].alias(c)
                for c in payload
                if c != "_rule"
            ],
            kept.alias("kept"),
            reasons.alias("reasons"),
            override.alias("safety_override"),
            (on & kept & F.coalesce(rule == "boundary_buffer", F.lit(False))).alias("borderline"),
            over.alias("budget_conflict"),
        )

    return folded.select(*keys, F.inline(F.transform("_items", decide)))


def explain(decisions: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Adds ``disabled_reason``: of a set that was not pruned, the error of its first failing row.

    ``decisions`` carries ``score_error``; the sets already lie together."""
    first = F.min(F.when(F.col("score_error").isNotNull(), F.struct("rank", "score_error"))).over(Window.partitionBy(*keys))
    reason = F.when(~F.col("pruning_enabled"), F.coalesce(first["score_error"], F.lit(UNEXPLAINED)))
    return decisions.withColumn("disabled_reason", reason)


def summarise(decisions: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Totals per set: tokens before and after, saving, flags."""
    base = F.sum("tokens")
    kept = F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0))
    unexplained = F.when(~F.min("pruning_enabled"), F.lit(UNEXPLAINED))
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("ranked_chunks"),
        F.count(F.when(F.col("kept"), 1)).alias("kept_chunks"),
        base.alias("baseline_tokens"),
        kept.alias("retained_tokens"),
        F.greatest(base - kept, F.lit(0)).alias("tokens_saved"),
        F.when(base > 0, F.greatest(base - kept, F.lit(0)) / base)
        .otherwise(F.lit(0.0))
        .alias("pct_tokens_saved"),
        F.max("budget_conflict").alias("budget_conflict"),
        F.min("pruning_enabled").alias("pruning_enabled"),
        (F.max("disabled_reason") if "disabled_reason" in decisions.columns else unexplained).alias("disabled_reason"),
    )
