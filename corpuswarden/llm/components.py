"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswarden.session import materialize


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them. Edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour, or the node itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    grown = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u"))
    return grown.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes with links.

    Each round is two stars, written as a table in the shared folder; rounds grow
    with the logarithm of the nodes, and end when nothing changes. Links with a
    null end and links of a node with itself are left out."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).isNull().alias("n1"), F.col(right).isNull().alias("n2"))
    edges = edges.where(~F.col("n1") & ~F.col("n2") & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    edges, _ = materialize(edges, "components")
    seen = _mark(edges)
    while True:
        half, _ = materialize(_large_star(edges), "components")
        edges, _ = materialize(_small_star(half), "components")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and summed hashes of the edges: the same for the same set."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
