"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable from it, for every node of the edges (a, b).

    Rounds of large-star and small-star: each links a node's larger neighbours, then its
    smaller ones, to the smallest, until stars remain. Loops and repeated edges don't matter.
    A node with very many edges is split by Spark as the skewed side of a join, whose other
    side has one row for each node.
    """
    a, b = F.col("a"), F.col("b")
    nodes = edges.select("a").union(edges.select(b.alias("a"))).distinct()
    edges = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while (state := _state(edges)) != before:
        before = state
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(b.alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return nodes.join(edges, "a", "left").select(a.alias("node"), F.coalesce(b, a).alias("component"))
