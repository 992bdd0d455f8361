"""Held-out evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed value: the name under which every evaluation is reported.
EVALUATION_METHOD = "leave-one-out-by-time"


def watched_violations(recommended: DataFrame, train: DataFrame) -> DataFrame:
    """Recommendations of items that the user has rated."""
    return recommended.join(train.select("userId", "movieId"), ["userId", "movieId"], "left_semi")


def per_user(test: DataFrame, predicted: DataFrame, recommended: DataFrame, k: int, threshold: int) -> DataFrame:
    """A row per test rating: prediction and errors, rank within the first k, hit, NDCG and MRR where it is relevant."""
    held = test.select("userId", F.col("movieId").alias("testMovieId"), F.col("rating").alias("actualRating"))
    scores = predicted.select("userId", F.col("movieId").alias("testMovieId"), F.col("score").alias("predictedScore"))
    ranks = recommended.where(F.col("rank") <= k).select("userId", F.col("movieId").alias("testMovieId"), F.col("rank").alias("recommendationRank"))
    sizes = recommended.groupBy("userId").agg(F.count("*").alias("recommendationCount"))
    joined = held.join(scores, ["userId", "testMovieId"], "left").join(ranks, ["userId", "testMovieId"], "left").join(sizes, "userId", "left")
    error = F.abs(F.col("predictedScore") - F.col("actualRating"))
    relevant = F.col("actualRating") >= threshold
    rank = F.col("recommendationRank")
    hit = relevant & rank.isNotNull()
    zero = F.lit(0.0)
    return joined.select(
        "userId", "testMovieId", "actualRating", "predictedScore", error.alias("absoluteError"), (error * error).alias("squaredError"), relevant.alias("isRelevant"),
        "recommendationRank", hit.cast("int").alias("hit"), F.when(hit, 1 / F.log2(rank + 1)).otherwise(zero).alias("ndcg"), F.when(hit, 1 / rank).otherwise(zero).alias("mrr"),
        F.coalesce("recommendationCount", F.lit(0)).alias("recommendationCount"),
    )


def metrics(users: DataFrame, k: int, threshold: int, watched: DataFrame | None = None, overlap: DataFrame | None = None) -> DataFrame:
    """One row of aggregates over ``per_user``'s rows; averages of ranking are over relevant rows, 0 if there is none."""
    relevant = F.col("isRelevant")
    mean = lambda c: F.coalesce(F.avg(F.when(relevant, c)), F.lit(0.0))
    rows, matched = F.count("*"), F.count("predictedScore")
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), rows.cast("double")), F.lit(0.0))
    listed = F.count_if(F.col("recommendationCount") > 0)
    out = users.agg(
        F.lit(EVALUATION_METHOD).alias("evaluation_method"), F.lit(k).alias("k"), F.lit(threshold).alias("relevance_threshold"), rows.alias("test_rows"),
        matched.alias("matched_test_predictions"), (rows - matched).alias("missing_test_predictions"), share(matched).alias("prediction_coverage"),
        F.avg("absoluteError").alias("mae"), F.sqrt(F.avg("squaredError")).alias("rmse"), F.count_if(relevant).alias("ranking_eligible_users"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("ranking_hits"), listed.alias("users_with_recommendations"), share(listed).alias("recommendation_user_coverage"),
        mean(F.col("hit") / k).alias("precision_at_k"), mean(F.col("hit")).alias("recall_at_k"), mean(F.col("hit")).alias("hit_rate_at_k"), mean(F.col("ndcg")).alias("ndcg_at_k"), mean(F.col("mrr")).alias("mrr_at_k"),
    )
    for name, found in (("watched_recommendations_found", watched), ("train_test_overlap_rows", overlap)):
        if found is not None:
            out = out.crossJoin(found.agg(F.count("*").alias(name)))
    return out
