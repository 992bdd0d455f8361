"""User histories and co-rated item pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def histories(ratings: DataFrame) -> DataFrame:
    """(userId, ratings array<struct<movieId, rating>>), by movie id."""
    return ratings.groupBy("userId").agg(F.sort_array(F.collect_list(F.struct("movieId", "rating"))).alias("ratings"))


def long_form(history: DataFrame) -> DataFrame:
    """Histories back as (userId, movieId, rating)."""
    return history.select("userId", F.inline("ratings"))


def pair_statistics(ratings: DataFrame) -> DataFrame:
    """(movieI < movieJ, commonUsers, sumXY, sumX2, sumY2) over the users that rated both.

    A self-join on the user: both sides are one exchange (reused), and a user with very many ratings is split
    by Spark's skew join. Sums combine before the second exchange. Users with one rating make no pair.
    """
    own = ratings.select("userId", "movieId", F.col("rating").cast("long").alias("rating"))
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.userId") == F.col("b.userId")) & (F.col("a.movieId") < F.col("b.movieId")))
    x, y = F.col("a.rating"), F.col("b.rating")
    return both.groupBy(F.col("a.movieId").alias("movieI"), F.col("b.movieId").alias("movieJ")).agg(
        F.count("*").alias("commonUsers"), F.sum(x * y).alias("sumXY"), F.sum(x * x).alias("sumX2"), F.sum(y * y).alias("sumY2")
    )


def pair_statistics_of(histories: DataFrame, wanted: Callable[[Column], Column] | None = None, tasks: int = 1) -> DataFrame:
    """``pair_statistics`` of histories (userId, ratings by movie id) for the first movies that ``wanted`` holds for.

    A rating goes to its movie's task with the later movies of its history, ids and ratings as two arrays: a fifth of
    what a row per pair takes in a shuffle. Pairs are made and summed there, ``tasks`` side by side.
    """
    placed = histories.select(F.posexplode("ratings.movieId").alias("k", "movieI"), F.col("ratings.movieId").alias("movies"), F.transform("ratings.rating", lambda r: r.cast("byte")).alias("stars"))
    placed = placed.where(F.col("k") + 1 < F.size("movies"))
    placed = placed if wanted is None else placed.where(wanted(F.col("movieI")))
    later = lambda c: F.slice(c, F.col("k") + 2, F.size(c))
    dealt = placed.select("movieI", F.col("stars")[F.col("k")].alias("x"), later("movies").alias("movies"), later("stars").alias("stars")).repartition(tasks, "movieI")
    both = dealt.select("movieI", F.col("x").cast("long").alias("x"), F.posexplode("movies").alias("k", "movieJ"), "stars").select("movieI", "movieJ", "x", F.col("stars")[F.col("k")].cast("long").alias("y"))
    x, y = F.col("x"), F.col("y")
    return both.groupBy("movieI", "movieJ").agg(F.count("*").alias("commonUsers"), F.sum(x * y).alias("sumXY"), F.sum(x * x).alias("sumX2"), F.sum(y * y).alias("sumY2"))


def pair_estimate(ratings: DataFrame) -> DataFrame:
    """One row: users, those with a single rating, and the pair contributions to come, the sum of c(c-1)/2."""
    per_user = ratings.groupBy("userId").agg(F.count("*").alias("c"))
    return per_user.agg(
        F.count("*").alias("users"), F.count_if(F.col("c") == 1).alias("singleItemUsers"),
        F.coalesce(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")), F.lit(0)).alias("pairContributions"),
    )
