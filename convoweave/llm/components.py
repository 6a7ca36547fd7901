"""Connected components of a link table: distributed union-find by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage


def _normal(edges: DataFrame) -> DataFrame:
    """``(v, u)`` with u < v, each once."""
    return edges.where(F.col("v") != F.col("u")).select(
        F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    hung = both.join(least, "v").where(F.col("u") > F.col("v"))
    return hung.select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    hung = edges.join(least, "v").where(F.col("u") != F.col("m"))
    return hung.select(F.col("u").alias("v"), F.col("m").alias("u")).union(
        least.select("v", F.col("m").alias("u"))
    ).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, label)`` for every linked vertex; the label is the smallest vertex it can reach.

    Every round hangs all larger neighbours of a vertex on its smallest one, then does the same
    with the smaller ones, until nothing changes; rounds grow with the logarithm of the
    longest chain. Only minima are gathered by vertex, so a vertex with many links is
    aggregated before it is shuffled. Rounds are written to shared storage; the driver learns
    whether one is the last. Links to itself, repeated and null links are harmless.
    """
    edges = links.select(F.col(a).alias("v"), F.col(b).alias("u")).dropna()
    edges = cut_lineage(_normal(edges))
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        # Done when each vertex hangs on one other that hangs on none.
        hung = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        inner = edges.select(F.col("u").alias("v")).join(hung, "v", "left_semi")
        if inner.union(hung.where(F.col("n") > 1).select("v")).isEmpty():
            break
    roots = edges.select(F.col("u").alias("v"), F.col("u").alias("label")).distinct()
    return edges.select("v", F.col("u").alias("label")).union(roots)
