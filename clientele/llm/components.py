"""Connected components of a graph given by its edges, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientele.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction.

    Large: every larger neighbour of a node points to the smallest node around it. Small: so do
    the smaller neighbours and the node itself. The minimum is aggregated before it is joined
    back, so a node with very many neighbours is one row in the aggregate.
    """
    around = edges.union(edges.select("b", "a")) if large else edges
    low = around.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    joined = around.join(low, around["a"] == low["u"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(low.select("u", "m"))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's smallest node.

    Self loops and nulls are ignored. Each round is written to the shared folder, so the plan does
    not grow and a lost executor does not repeat earlier rounds. The number of rounds grows with the
    logarithm of the graph's size.
    """
    now = stage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    while True:
        rows = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(rows) == mark:
            break
        mark = tuple(rows)
        now = stage(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
