"""Connected components of a graph given as pairs, by rounds of joins on the cluster.

Each round is a large-star and a small-star step (Kiveris et al., "Connected components in MapReduce and
beyond"): every node hands its larger neighbours, then its smaller ones, to its least neighbour. The edges
become stars around the least node of their component within about the square of the logarithm of its
size rounds. Edges are never collected; each round is written to the shared folder, so that a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node ``a`` to the smaller ``b``."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return lower.where("a != b").distinct()


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in a pair; the component is its least node.

    Pairs with a null and of a node with itself say nothing. No pairs give no rows.
    """
    edges = pairs.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).where("a != b").distinct()
    edges, before = materialize(edges, "edges"), None
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        # The sums are the same only if no edge has moved.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
