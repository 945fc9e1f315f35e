"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, group): each node of ``edges`` (a, b) with the smallest node that it is connected to.

    Alternates large-star and small-star steps until the edges are stars. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most; only two numbers a round come to
    the driver. The rounds grow as the square of the logarithm of the nodes at most. Self-loops and repeated edges are allowed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = cut(_small_star(_large_star(now)))
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if tuple(row) == mark:
            heads = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("group"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(heads)
        mark = tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter("u <> v").distinct()
