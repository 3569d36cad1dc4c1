"""Connected components over links, by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.session import checkpoint


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `root` (the smallest node of its component) of every node that has a link to another.

    `links` has two columns of one ordered type; direction, repeats and links to itself do not matter. Each round hangs
    every node's larger neighbours, then its smaller ones, under its smallest neighbour, so paths shrink geometrically and
    no list of neighbours is ever built: minima are aggregated before the shuffle.
    """
    high = F.greatest(a, b)
    low = F.least(a, b)
    edges = checkpoint(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    while True:
        # Large star: each larger neighbour of u is linked to the smallest of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = checkpoint(after.union(small.select("u", F.col("m").alias("v"))).distinct())
        # Done when every node hangs under a node that hangs under none.
        open_links = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if open_links.isEmpty() and several.isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after
