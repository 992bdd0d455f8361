"""Weighted-average candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.checks import told
from tessera.functions.numbers import ten_rounded


def published(relations: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Relations as the next stage reads them: a ten-decimal similarity must lie in (0, 1].

    One that rounds to zero fails the query, or is dropped with ``drop_zero``.
    """
    if drop_zero:
        return relations.where("sim10 > 0")
    name = F.concat_ws(",", "sourceId", "neighborId")
    fine = F.when((F.col("sim10") > 0) & (F.col("sim10") <= 10**10), F.col("sim10")).otherwise(F.raise_error(told("similarity must lie in (0, 1]", name)).cast("long"))
    return relations.withColumn("sim10", fine)


def contributions(ratings: DataFrame, relations: DataFrame, weight: Column) -> DataFrame:
    """(userId, movieId: the candidate, weight, rating): a row per rated item and neighbour of it."""
    rated = ratings.select("userId", F.col("movieId").alias("sourceId"), "rating")
    near = relations.select("sourceId", F.col("neighborId").alias("movieId"), weight.alias("weight"))
    return rated.join(near, "sourceId").select("userId", "movieId", "weight", "rating")


def predictions(ratings: DataFrame, relations: DataFrame, precision: str = "published") -> DataFrame:
    """(userId, movieId, score) for every candidate, watched ones included.

    Sums of ten-decimal similarities are sums of whole numbers, so they do not depend on the partitioning.
    """
    whole = precision == "published"
    each = contributions(ratings, published(relations) if whole else relations, F.col("sim10") if whole else F.col("similarity"))
    sums = each.groupBy("userId", "movieId").agg(F.sum(F.col("weight") * F.col("rating")).alias("num"), F.sum(F.abs("weight")).alias("den"))
    score = F.col("num").cast("double") / F.col("den").cast("double")
    out = sums.where("den <> 0").select("userId", "movieId", score.alias("score"))
    return out.withColumn("score", ten_rounded(F.col("score"))) if whole else out
