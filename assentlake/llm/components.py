"""Connected components by alternating stars (Kiveris et al., 2014), in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assentlake.session import staged


def _star(edges: DataFrame, inner: bool) -> DataFrame:
    """One star operation on distinct (u, v) with u > v.

    ``inner`` links the smaller neighbours and the node itself to the smallest of them, else
    the larger neighbours are linked to the smallest of all.
    """
    if inner:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        out = moved.unionByName(own)
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours v of u: exactly the edges, read from the other end.
        out = edges.select(F.col("v").alias("c"), F.col("u").alias("w")).join(
            low.withColumnRenamed("u", "c"), "c"
        ).select(F.col("w").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (a, b) that are not their component's smallest.

    The edges shrink to stars around the smallest nodes; every step is written to the shared
    folder. Only a count and a checksum reach the driver. Links of a node to itself and
    repeated links are harmless; no links give no rows.
    """
    edges = staged(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state[0] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        edges = staged(_star(_star(edges, False), True), "edges")
