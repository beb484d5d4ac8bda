"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of edges (a, b): long ids, any direction, repeats and loops allowed.

    Each round is written to the shared folder and the one before deleted. The
    rounds end when a round changes no edge, which takes a number of rounds that
    grows with the logarithm of the longest chain. The result is written too.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = materialise(_small(_large(now)), "edges")
        free(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
    free(now)
    return found
