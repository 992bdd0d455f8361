"""Reporting views: metadata, users, comparisons, bundle checks, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.checks import must_be_empty


def titled(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows with title, year and genres; unknown movies are called ``Movie <id>``."""
    kept = [c for c in rows.columns]
    joined = rows.join(metadata.select("movieId", "title", "year", "genres"), "movieId", "left")
    title = F.coalesce("title", F.concat(F.lit("Movie "), F.col("movieId").cast("string")))
    return joined.select(*kept, title.alias("title"), "year", F.coalesce("genres", F.lit("")).alias("genres"))


def user_summary(ratings: DataFrame, recommended: DataFrame) -> DataFrame:
    """A row per user with ratings: counts, mean rating, mean and highest score (null without recommendations)."""
    seen = ratings.groupBy("userId").agg(F.count("*").alias("watchedMovieCount"), F.avg("rating").alias("averageHistoricalRating"))
    recs = recommended.groupBy("userId").agg(F.count("*").alias("n"), F.avg("score").alias("averageRecommendationScore"), F.max("score").alias("highestRecommendationScore"))
    return seen.join(recs, "userId", "left").select("userId", "watchedMovieCount", F.coalesce("n", F.lit(0)).alias("recommendationCount"), "averageHistoricalRating", "averageRecommendationScore", "highestRecommendationScore")


def profiles(histories: DataFrame, lists: DataFrame) -> DataFrame:
    """Histories with their recommendation lists, empty where there is none."""
    empty = F.array().cast(lists.schema["recommendations"].dataType)
    return histories.join(lists, "userId", "left").withColumn("recommendations", F.coalesce("recommendations", empty))


def checked_profiles(histories: DataFrame, lists: DataFrame) -> DataFrame:
    """``profiles``, once it is sure that every list's user has a history."""
    must_be_empty(unknown_users(lists, histories), "a list's user has no history")
    return profiles(histories, lists)


def unknown_users(recommended: DataFrame, ratings: DataFrame) -> DataFrame:
    """Users with recommendations and no history."""
    return recommended.select("userId").distinct().join(ratings.select("userId").distinct(), "userId", "left_anti")


def order_errors(recommended: DataFrame) -> DataFrame:
    """Recommendations that break the order of their list: a higher score, or an equal score with a lower id, than the one before."""
    before = Window.partitionBy("userId").orderBy("rank")
    rows = recommended.withColumns({"lastScore": F.lag("score").over(before), "lastMovie": F.lag("movieId").over(before)})
    return rows.where("score > lastScore OR (score = lastScore AND movieId < lastMovie)").select(*recommended.columns)


def bundle_checks(ratings: DataFrame, recommended: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """One row of violation counts: watched, repeated, out of order, score out of range, unknown user; and the share of users with a list."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    repeated = recommended.groupBy("userId", "movieId").count().where("count > 1")
    watched = recommended.join(ratings.select("userId", "movieId"), ["userId", "movieId"], "left_semi")
    users = ratings.select("userId").distinct().join(recommended.select("userId", F.lit(1).alias("has")).distinct(), "userId", "left")
    out = one(watched, "watchedViolations")
    for df in (
        one(repeated, "duplicateViolations"), one(order_errors(recommended), "orderViolations"), one(recommended.where(~F.col("score").between(low, high)), "scoreViolations"),
        one(unknown_users(recommended, ratings), "unknownUsers"), users.agg(F.try_divide(F.count("has").cast("double"), F.count("*").cast("double")).alias("userCoverage")),
    ):
        out = out.crossJoin(df)
    return out


def prefix_subset(ratings: DataFrame, target: int) -> DataFrame:
    """All ratings of the first users, by id, up to the one that reaches ``target`` ratings.

    Users are counted first; the running total needs their order, so it is built from totals of id ranges: only
    ranges' totals meet in one task.
    """
    counts = ratings.groupBy("userId").agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange("userId").select("userId", "c", F.spark_partition_id().alias("part"))
    totals = ranged.groupBy("part").agg(F.sum("c").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy("userId").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranged.withColumn("within", within).join(before, "part").where(F.col("before") + F.col("within") < target).select("userId")
    return ratings.join(chosen, "userId", "left_semi")


def external(ratings: DataFrame, target: int) -> DataFrame:
    """The prefix subset of an external set, which must hold ``target`` ratings."""
    have = ratings.count()
    if have < target:
        raise ValueError(f"the input has {have} ratings, fewer than {target}")
    return prefix_subset(ratings, target)


def metric_text(value: Column, kind: str) -> Column:
    """A metric for display: count, number or percent; ``N/A`` for null."""
    shown = {"count": F.format_string("%d", value.cast("long")), "number": F.format_string("%.3f", value), "percent": F.format_string("%.3f%%", value * 100)}[kind]
    return F.when(value.isNull(), F.lit("N/A")).otherwise(shown)
