"""Message pruning on a stream of requests.

A span never leaves its message and the query of a request comes with it, so no
state is carried between batches: every micro-batch is pruned by the batch
operator, which makes the result identical to a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.config import MESSAGE_PRESET
from gleaner.operators.messages import prune_chat


def explode_requests(requests: DataFrame) -> DataFrame:
    """``conv_id, messages array<struct<role, text>>`` to one row per message.

    A request without messages keeps one row with a null turn."""
    return requests.select("conv_id", F.posexplode_outer("messages").alias("turn", "_m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "_m.role", "_m.text"
    )


def prune_stream(
    requests: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    preset: str = MESSAGE_PRESET,
    auto_mark_tool_results: bool = False,
    **trigger,
) -> StreamingQuery:
    """Prune a stream of whole requests; ``write(pruned, batch_id)`` stores a batch.

    ``write`` should be idempotent per batch id: a batch is repeated after a
    failure."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        messages = explode_requests(frame)
        write(prune_chat(messages, preset=preset, auto_mark_tool_results=auto_mark_tool_results), batch_id)

    return (
        requests.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
