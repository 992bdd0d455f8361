"""Connected components of an edge table, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node that it reaches.

    Large-star and small-star rounds, until a round changes nothing; every round's edges are a table in
    the shared folder. A node's links are never gathered: a round only takes minima by node and joins
    them. An empty table gives an empty table; self-links are ignored.
    """
    links = common.materialise(edges.where("a <> b").select("a", "b"), "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(links)
    while before[0]:
        new = common.materialise(_small_star(_large_star(links)), "links")
        common.remove(links)
        links, after = new, mark(new)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
