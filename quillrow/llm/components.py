"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them.  Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connect(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """links (a, b): one row (node, root) a node that isn't its component's least node.

    Each round is written to the shared folder, so the lineage stays short, and the one before is deleted; the
    number of rounds grows with the logarithm of the longest path.  Least neighbours are aggregated by task
    before they are shuffled; the joins with them are shuffles of their own, in which adaptive execution splits
    the partition of a hub.  Self-links and repeated links do no harm.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        before, edges = edges, materialize(_small_star(_large_star(edges)), "links")
        discard(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
