"""Connected components of an edge table by alternating large and small stars, all on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step over a saved table (a, b) with a > b: hangs each node's neighbours (small: the smaller ones and itself) on the smallest of them."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    out = hung.select(F.col("b").alias("v"), "m") if small else hung.filter("b > a").select(F.col("b").alias("v"), "m")
    if small:
        out = out.unionByName(least.select(F.col("a").alias("v"), "m"))
    return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), both long; the root is a component's smallest node.

    Loops, repeated edges and either direction are fine; no edges give no rows. A node with very many
    neighbours is one row of each sum and one side of a join that adaptive execution splits.
    """
    edges = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = save(_stars(save(_stars(edges, False), "stars"), True), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
