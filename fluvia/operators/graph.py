"""Connected components by alternating star contractions; every round is joins and aggregates on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvia.lineage import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an undirected edge table (src, dst), the smallest node it is connected to.

    Nodes are of any ordered type. Null ends and loops are left out, repeated edges do no harm; a node without an edge
    to another one has no row. Each round replaces edges by edges to smaller nodes (large star, then small star), so the
    number of rounds follows the logarithm of the size and not the diameter. Aggregates are combined before each
    shuffle, and a hub's edges can be split by AQE in the join that follows.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    # every edge points from the larger node (src) to the smaller one (dst)
    now = cut(edges.where("src is not null and dst is not null and src <> dst").select(high.alias("src"), low.alias("dst")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        large = large.distinct()
        small_least = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(small_least, "src")
        small = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small_least.select("src", F.col("m").alias("dst")))
        now = cut(small.distinct(), replaces=now)
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
