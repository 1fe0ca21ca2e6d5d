"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by one of its nodes.

    Each round every node joins the neighbour, or itself, of least hash under the round's seed; edges
    are redrawn between the joined nodes and the rest is done when none is left. The hash makes
    long paths shrink by a constant share a round. Only minima are aggregated, so a node with
    very many edges costs one row per task; both tables of a round are written, so a lost executor costs
    one round at most.
    """
    edges = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both, turn = edges.union(edges.select("b", "a")), len(steps)

        def code(column):
            return F.xxhash64(F.col(column), F.lit(turn))  # noqa: B023

        near = both.groupBy("a").agg(F.min(code("b")).alias("code"), F.min_by("b", code("b")).alias("b"))
        step = written(near.select(F.col("a").alias("node"), F.when(F.col("code") < code("a"), F.col("b"))
                                   .otherwise(F.col("a")).alias("to")), "steps")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = written(edges.join(left, "a").join(right, "b").filter("to_a <> to_b")
                        .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
                        "edges")
    # Later steps have fewer nodes, so the moves are put together from the last to the first.
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for step in reversed(steps):
        further = labels.withColumnsRenamed({"node": "to", "component": "last"})
        labels = written(step.join(further, "to", "left").select("node", F.coalesce("last", "to").alias("component")), "labels")
    return labels
