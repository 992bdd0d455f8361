"""Removal of rated items and Top-K ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.internal import InternalFunction

from tessera.functions.checks import checked, must_be_empty, told


def unseen(predicted: DataFrame, ratings: DataFrame) -> DataFrame:
    """Candidates that the user has not rated."""
    return predicted.join(ratings.select("userId", "movieId"), ["userId", "movieId"], "left_anti")


def without_history(predicted: DataFrame, ratings: DataFrame) -> DataFrame:
    """Users that have predictions and no ratings."""
    return predicted.select("userId").distinct().join(ratings.select("userId").distinct(), "userId", "left_anti")


def with_history(predicted: DataFrame, ratings: DataFrame) -> DataFrame:
    """The predictions, as a plan that fails at a user that has no ratings."""
    users = ratings.select(F.col("userId").alias("known")).distinct()
    joined = predicted.join(users, F.col("userId") == F.col("known"), "left")
    return joined.withColumn("userId", checked(F.col("known").isNotNull(), F.col("userId"), "long", told("a prediction's user has no history", F.col("userId").cast("string")))).drop("known")


def ranked(candidates: DataFrame, most: int) -> DataFrame:
    """(userId, rank, movieId, score): by score, then movie id; users without a candidate have no row."""
    order = Window.partitionBy("userId").orderBy(F.desc("score"), "movieId")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("userId", "rank", "movieId", "score")


def best(predicted: DataFrame, ratings: DataFrame, most: int) -> DataFrame:
    """(userId, predictions, watched, best): of each user the predictions, those of rated movies, and the ``most`` best of the others as (rank, movieId, score), in one pass over the predictions and without a sort of them."""
    seen = ratings.select("userId", "movieId", F.lit(True).alias("watched"))
    candidate = F.when(F.col("watched").isNull(), F.struct((-F.col("score")).alias("low"), "movieId"))
    found = predicted.join(seen, ["userId", "movieId"], "left").groupBy("userId").agg(F.count("*").alias("predictions"), F.count("watched").alias("watched"), InternalFunction.collect_top_k(candidate, most, True).alias("best"))
    ranks = F.transform(F.sort_array("best"), lambda x, i: F.struct((i + 1).alias("rank"), x["movieId"].alias("movieId"), (-x["low"]).alias("score")))
    return found.withColumn("best", ranks)


def recommendations(predicted: DataFrame, ratings: DataFrame, most: int, check: bool = False) -> DataFrame:
    """The ``most`` best unseen candidates of each user; ``check`` fails first if a prediction's user has no history."""
    if check:
        must_be_empty(without_history(predicted, ratings), "a prediction's user has no history")
    return ranked(unseen(predicted, ratings), most)


def lists(recommended: DataFrame) -> DataFrame:
    """(userId, recommendations array<struct<rank, movieId, score>>), in order."""
    return recommended.groupBy("userId").agg(F.sort_array(F.collect_list(F.struct("rank", "movieId", "score"))).alias("recommendations"))
