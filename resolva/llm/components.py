"""Connected components by alternating star contraction.

Edges (a, b) are long pairs. Large-star links every node's larger neighbours to
its least neighbour, small-star links a node's smaller neighbours and itself to
the least of them; both keep the components, and repeated they end in stars
whose centres are the components' least nodes. Group minima are partial
aggregates joined back, so a hub's neighbours are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # both directions; link the larger neighbours to the least of node and neighbours
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = pairs.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:      # from larger to smaller; link the smaller neighbours and the node itself to the least
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        out = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a smaller node that has none."""
    more = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    onward = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return more.unionByName(onward).unionByName(edges.filter("a < b").select("a")).isEmpty()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the
    least node of its component. Self loops are dropped."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), tag)
    while not _are_stars(edges):
        edges = materialize(_star(_star(edges, large=True), large=False), tag)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
