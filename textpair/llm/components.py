"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours below the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``; the root is the smallest node.

    Rounds repeat until the edges no longer change, which is after
    O(log^2 n) of them.  Each round is written to the shared folder, so its
    lineage is a scan; the driver sees a count and a checksum only.  A node with
    many edges is a key of joins that adaptive execution splits.
    """
    current = stored(edges.where("u != v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        current = stored(small_star(large_star(current).distinct()).distinct(), "edges")
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
