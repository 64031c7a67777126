"""Connected components by large and small stars, as joins with a written table per round.

Minima per node are combined before the shuffle and written, so that the join of a node
with many edges can be split. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import pin


def _minima(edges: DataFrame) -> DataFrame:
    return pin(edges.groupBy("u").agg(F.min("v").alias("m")), "star-minima")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _minima(edges)
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead straight to the least node: one per node, and none from a head."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    onward = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return several.union(onward).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` links; the component is its least node."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = pin(edges, "links")
    while not _settled(edges):
        edges = pin(_small_star(pin(_large_star(edges), "large-star")), "small-star")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pin(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads), "components")
