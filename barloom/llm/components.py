"""Connected components by alternating star contractions, entirely in joins and minima."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of `edges` (columns a, b) that has an edge to another.

    Each round hangs larger neighbours on a node's smallest neighbour, then does the same with smaller ones, until
    nothing changes; rounds grow with the logarithm of the longest path. Only minima are taken of a node's
    neighbours, so a node with very many of them is combined map-side and never gathered. Rows with a null end are
    no edges; repeated edges and loops change nothing.
    """
    stars = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
