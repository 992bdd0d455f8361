"""Leave-one-out splits and what is checked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.checks import must_be_empty

ORDERS = {"date": ["date", "movieId"], "timestamp": ["timestamp", "movieId"], "item": ["movieId"]}


def leave_one_out(ratings: DataFrame, by: str = "date") -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's last rating in the order, if there are two at least, is the test."""
    order = ORDERS[by] if by in ORDERS else [by, "movieId"]
    user = Window.partitionBy("userId")
    marked = ratings.withColumns({"__place": F.row_number().over(user.orderBy(*[F.desc(c) for c in order])), "__n": F.count("*").over(user)})
    test = (F.col("__place") == 1) & (F.col("__n") >= 2)
    return marked.where(~test).drop("__place", "__n"), marked.where(test).drop("__place", "__n")


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """(userId, movieId) in both."""
    return train.select("userId", "movieId").intersect(test.select("userId", "movieId"))


def late_training(train: DataFrame, test: DataFrame, by: str = "timestamp") -> DataFrame:
    """Users with a training rating later than their test rating."""
    last = train.groupBy("userId").agg(F.max(by).alias("last"))
    return last.join(test.select("userId", F.col(by).alias("held")), "userId").where("last > held")


def cold_start_items(train: DataFrame, test: DataFrame) -> DataFrame:
    """Items of the test that no training rating has."""
    return test.select("movieId").distinct().join(train.select("movieId").distinct(), "movieId", "left_anti")


def checked_split(ratings: DataFrame, by: str = "date") -> tuple[DataFrame, DataFrame]:
    """The split, once it is sure not to overlap or to leak."""
    train, test = leave_one_out(ratings, by)
    must_be_empty(overlap(train, test), "train and test overlap")
    if by != "item":
        must_be_empty(late_training(train, test, ORDERS[by][0] if by in ORDERS else by), "a test rating is earlier than a training rating")
    return train, test


def statistics(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row about a split."""
    per_user = train.groupBy("userId").agg(F.count("*").alias("c"))
    of_train = per_user.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("trainRows"), F.count("*").alias("trainUsers"), F.coalesce(F.min("c"), F.lit(0)).alias("minTrainRatingsPerUser"),
        F.coalesce(F.max("c"), F.lit(0)).alias("maxTrainRatingsPerUser"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("avgTrainRatingsPerUser"),
    )
    of_test = test.agg(F.count("*").alias("testRows"), F.count_distinct("movieId").alias("testItems"))
    items = train.agg(F.count_distinct("movieId").alias("trainItems"))
    cold = cold_start_items(train, test).agg(F.count("*").alias("coldStartTestItems"))
    both = overlap(train, test).agg(F.count("*").alias("trainTestOverlapRows"))
    joined = of_train.crossJoin(of_test).crossJoin(items).crossJoin(cold).crossJoin(both)
    total = F.col("trainRows") + F.col("testRows")
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), total.cast("double")), F.lit(0.0))
    return joined.withColumns({"inputRatings": total, "trainPercentage": share("trainRows"), "testPercentage": share("testRows"), "usersWithoutTest": F.col("trainUsers") - F.col("testRows")})
