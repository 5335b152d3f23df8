"""Connected components of a table of links, by repeated star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import drop, save


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component_id), the smallest node reachable; only linked nodes have a row.

    Each round hangs every neighbour on the smallest one seen from its node (large star), then on the smallest below
    it (small star), until nothing changes; rounds grow with the logarithm of the longest path. Minima are aggregated
    before they are shuffled, so a hub with very many neighbours is no single task's work. Null ends and loops are
    dropped, repeated links count once; no links give an empty table.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = save(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(least.where("m < u"), "u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        large = save(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = save(small.where("u > v").distinct(), "small-star")
        # done when every node hangs on one node that hangs on none
        again = small.groupBy("u").count().where("count > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        drop(edges, large)
        edges = small
        if not again:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
