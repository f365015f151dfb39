"""Connected components of a graph whose nodes are longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.sizing import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> one row (node, component) per node, its smallest reachable node.

    Each round every node hooks to its smallest neighbour, follows that hook once, and
    the graph is contracted; every node with an edge merges, so the rounds are
    logarithmic in the size of a component.  Loops and repeated edges do no harm.
    """
    graph = materialise(edges.filter("a <> b").select("a", "b").distinct())
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while graph.head(1):
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(
            both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        )
        twice = hooks.select(F.col("a").alias("to"), F.col("to").alias("then"))
        jumps = materialise(hooks.join(twice, "to").select("a", F.col("then").alias("to")))
        found = materialise(
            found.join(jumps, found.component == jumps.a, "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        )
        ends = jumps.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        graph = materialise(
            graph.join(jumps, "a")
            .join(ends, "b")
            .select(F.col("to").alias("a"), F.col("to_b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    return found
