"""Connected components of an edge table, as DataFrame rounds that contract the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; component is its least node.

    Each round hooks every node to its least neighbour (a grouped minimum with map-side
    partials, so a hub is no hot key), follows the parents ``jumps`` times, rewrites the edges
    between parents and drops those that became loops. Stars end in one round, paths in a
    number of rounds logarithmic in their length. Labels and edges stay in stage tables; only
    "any edge left" comes to the driver. Null ends and loops are dropped; an empty table gives
    no rows.
    """
    edges = edges.where(F.col("u") != F.col("v")).select("u", "v")
    names = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = staged(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("p")), "cc-parent")
        if names is None and parent.isEmpty():
            return parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        for _ in range(jumps):
            up = parent.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            parent = (parent.join(up, parent["p"] == up["q"], "left")
                      .select("u", F.coalesce("pp", "p").alias("p")))
        parent = staged(parent, "cc-jumped")
        if names is None:
            names = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            names = (names.join(parent, names["component"] == parent["u"], "left")
                     .select("node", F.coalesce("p", "component").alias("component")))
        names = staged(names, "cc-names")
        a = parent.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = staged(edges.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b"))
                       .where(F.col("pa") != F.col("pb"))
                       .select(F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v"))
                       .distinct(), "cc-edges")
        if edges.isEmpty():
            return names
