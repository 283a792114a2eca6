"""Connected components of links between documents, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); the component is its smallest node.

    Large-star and small-star steps take turns: each node's larger neighbours, then its smaller ones, are hung on
    its smallest neighbour, until no link changes. Rounds grow with the logarithm of the longest chain; a node
    with very many neighbours is one small aggregate and one join key that Spark can split."""
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = saved(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
