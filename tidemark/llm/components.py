"""Connected components of an edge table by alternating large and small stars.

Each round hangs the neighbours of a node under the smallest node near it; rounds go on until no edge changes, which
takes about the logarithm of the longest path. Only joins, minima and distinct rows are used: a node with many
neighbours is never gathered, and edges of a node that holds a large share of them meet its minimum by broadcast,
where they are. Rounds are checkpointed, and the driver sees one sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.skew import join_facts
from tidemark.operators.ordering import settle


def _lowest(edges: DataFrame) -> DataFrame:
    """a, low (the smallest b) and degree of every a."""
    return edges.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes under the smallest of node and neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("a", F.least("a", "low").alias("low"), "degree")
    hung = join_facts(both.filter("b > a"), low, ["a"], "degree")
    return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go under the smallest of them. Edges have a > b."""
    low = _lowest(edges)
    hung = join_facts(edges, low, ["a"], "degree").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node in edges (a, b) but the roots themselves.

    Self-loops and NULL ends are dropped, directions do not matter.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = settle(edges), None
    while True:
        # Stars are reached when every node has one edge and no node is both above and below.
        edges = settle(_small_star(settle(_large_star(edges))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
