"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task may hold; so few need no shuffles.
FEW = 100_000


def _lowest(edges: DataFrame, few: bool) -> DataFrame:
    """edges with `low`, the least v of their u: a window over few edges, else a join, so that no task holds all of a hub's."""
    if few:
        return edges.withColumn("low", F.min("v").over(Window.partitionBy("u")))
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("low")), "u")


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _lowest(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
    return _lowest(down, few).select(F.inline(ends)).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, root) for every node that has an edge to another one.

    Null ends and self loops are ignored, repeated edges count once. root is the
    smallest node that can be reached. Every round is two shuffled aggregations and
    joins with partial aggregation, so a node with very many edges is met as a
    pre-aggregated minimum and a split join side. Lineage is cut each round. Up to FEW edges
    are one partition, whose rounds are the same and need no shuffles.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(edges)
    while True:
        few = seen[0] <= FEW
        edges = cut(_small_star(_large_star(edges.coalesce(1) if few else edges, few), few))
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
