"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _towards_least(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node it knows ("large star")."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _among_smaller(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them ("small star").

    Edges come as (larger, smaller).
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the least node of its component.

    Both steps keep components and shorten paths, until every edge leads to a
    root. A node with very many neighbours is split by the skew join, its least
    neighbour is found by partial aggregation, and nothing but one summary row
    a round reaches the driver.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        summary = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summary == before or summary[0] == 0:
            break
        before = summary
        now = stored(_among_smaller(stored(_towards_least(now), "edges")), "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
