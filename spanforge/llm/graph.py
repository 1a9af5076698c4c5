"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) of every node in ``edges`` (src long, dst long).

    Loops and repeated edges have no effect; no edges give no rows. Every round halves the depth of the trees of
    links, so the rounds grow with the logarithm of the longest path. Neighbours are never gathered into a list.
    """
    e = materialize(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u to the least neighbour of u
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        # small star: u and its smaller neighbours to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", "m")).distinct()
        small = materialize(small, "small-star")
        # a forest of stars: every node has one edge, and no centre has one
        loose = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        deep = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        done = loose.isEmpty() and deep.isEmpty()
        for old in (e, large):
            drop_shared(old)
        e = small
        if done:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
