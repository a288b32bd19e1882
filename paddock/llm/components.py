"""Connected components of a link table, by alternating large-star and small-star steps.

Every round is a pair of groupings over the links. The links stay in Spark: a round writes its links to
the shared folder, and only the count of changes reaches the driver. Rounds grow as the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's neighbours at the least of them: all greater ones (large) or all smaller ones (small)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return met.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node that has a link; ``edges`` has a and b."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = None
    for _ in range(rounds):
        edges = materialize(_star(_star(edges, True), False).where("a != b"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == now:
            break
        told = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
