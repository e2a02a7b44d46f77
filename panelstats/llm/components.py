"""Connected components of an edge table, by hooking to the smallest neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.session import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    `edges` has integer columns a and b; direction, loops and repeats do not matter. Each round replaces every edge by
    edges of its ends to the smallest node seen from either, until all edges are stars around their roots. Rows per
    round do not exceed the edges; a node with many edges is reduced on the map side first.
    """
    stars = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # every node's smallest neighbour, itself included; then larger neighbours and the node hang on it
        ends = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = stars.join(low, "b").select("a", F.col("m").alias("b"))
        own = low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = large.unionByName(own).where("a <> b").distinct()
        # every node's smaller neighbours hang on the smallest of them
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
