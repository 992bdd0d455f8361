"""Counters of the stages: observed while a query runs, or a row of counts about a stage's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tessera import schemas
from tessera.operators import similarity as similarities


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df``, and what ``observation.get`` gives once it ran, without another pass."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen


def observed_pairs(pairs: DataFrame) -> tuple[DataFrame, Observation]:
    return observed(pairs, "pairs", finalPairs=F.count("*"), contributions=F.coalesce(F.sum("commonUsers"), F.lit(0)))


def observed_predictions(predicted: DataFrame) -> tuple[DataFrame, Observation]:
    return observed(predicted, "predictions", predictions=F.count("*"), lowestScore=F.min("score"), highestScore=F.max("score"))


def observed_recommendations(recommended: DataFrame) -> tuple[DataFrame, Observation]:
    return observed(recommended, "recommendations", recommendationRows=F.count("*"), usersEmitted=F.count_if(F.col("rank") == 1))


def _row(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.crossJoin(df)
    return out


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def history(lines: DataFrame, parsed: DataFrame, unique: DataFrame) -> DataFrame:
    """From the text lines, the parsed ratings and the unique ratings."""
    header = F.col("value") == schemas.RATINGS_HEADER
    out = _row(lines.agg(F.count("*").alias("inputRows"), F.count_if(header).alias("headerRows")), _n(parsed, "validRatingRows"), unique.agg(F.count("*").alias("outputRatings"), F.count_distinct("userId").alias("usersEmitted")))
    return out.withColumn("exactDuplicatesIgnored", F.col("validRatingRows") - F.col("outputRatings"))


def pair_facts(least: int) -> dict[str, Column]:
    """What the stages' counters need of pair statistics, to be observed while a text of them is scanned once."""
    return {"validPairRows": F.count("*"), "commonUserContributions": F.coalesce(F.sum("commonUsers"), F.lit(0)), "pairsFilteredByMinCommonUsers": F.count_if(F.col("commonUsers") < least)}


def pairs(ratings: DataFrame, table: DataFrame | None, facts: DataFrame | None = None) -> DataFrame:
    """From the long-form histories and their pair statistics, or the one row ``facts`` of ``pair_facts``."""
    users = ratings.groupBy("userId").agg(F.count("*").alias("c"))
    of_users = users.agg(F.count("*").alias("validUserHistories"), F.count_if(F.col("c") == 1).alias("usersWithSingleItem"), F.coalesce(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")), F.lit(0)).alias("pairsEmitted"))
    found = table.agg(*[c.alias(k) for k, c in pair_facts(1).items()]) if facts is None else facts
    return _row(of_users, found.select(F.col("validPairRows").alias("finalUnorderedPairs"), "commonUserContributions"))


def similarity(table: DataFrame, least: int, method: str, most: int, facts: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """From pair statistics, for a method with its parameters. With the one row ``facts`` of all of them, ``table`` need only hold those with enough common users; ``after``: the pruned relations, if they are at hand."""
    kept = similarities.supported(table, least)
    before = {"cosine": similarities.cosine, "cooccurrence": similarities.cooccurrence}[method](kept)
    after = similarities.top_l(before, most) if after is None else after
    found = table.agg(*[c.alias(k) for k, c in pair_facts(least).items()]) if facts is None else facts
    counts = found.select("validPairRows", "pairsFilteredByMinCommonUsers")
    out = _row(counts, before.agg(F.count("*").alias("directedRelationsBeforeTopL"), F.count_distinct("sourceId").alias("sourceItems")), _n(after, "directedRelationsAfterTopL"))
    created = (F.col("validPairRows") - F.col("pairsFilteredByMinCommonUsers")) * 2
    return out.withColumn("zeroDenominatorRelationsSkipped", created - F.col("directedRelationsBeforeTopL")).withColumn("directedRelationsCreated", F.col("directedRelationsBeforeTopL"))


def joined(ratings: DataFrame, relations: DataFrame) -> DataFrame:
    """From the histories and the relations: what scoring joins."""
    sources = relations.groupBy("sourceId").agg(F.count("*").alias("n"))
    movies = ratings.groupBy(F.col("movieId").alias("sourceId")).agg(F.count("*").alias("r")).join(sources, "sourceId", "left")
    return movies.agg(
        F.count("n").alias("sourceMoviesJoined"), F.count_if(F.col("n").isNull()).alias("sourceMoviesWithoutSimilarities"), F.coalesce(F.sum(F.col("n") * F.col("r")), F.lit(0)).alias("contributionsEmitted"),
    )


def per_user(predicted: DataFrame, ratings: DataFrame) -> DataFrame:
    """(userId, predictions, watched): the predictions of each user, and those of movies that the user has rated."""
    seen = ratings.select("userId", "movieId", F.lit(True).alias("watched"))
    return predicted.join(seen, ["userId", "movieId"], "left").groupBy("userId").agg(F.count("*").alias("predictions"), F.count("watched").alias("watched"))


def scoring(ratings: DataFrame, relations: DataFrame, predicted: DataFrame | None, counted: DataFrame | None = None) -> DataFrame:
    """From the histories, the relations and the predictions made of them, or what ``per_user`` says of these."""
    users = ratings.agg(F.count_distinct("userId").alias("userHistoryRows"), F.count("*").alias("userRatingJoinRecords"))
    return _row(users, _n(relations, "validSimilarityRows"), joined(ratings, relations), _n(predicted, "predictionRows") if counted is None else counted.agg(F.coalesce(F.sum("predictions"), F.lit(0)).alias("predictionRows")))


def top_k(ratings: DataFrame, predicted: DataFrame | None, recommended: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """From the histories, the predictions, or what ``per_user`` says of these, and the recommendations kept of them."""
    users = ratings.select("userId").distinct()
    counted = per_user(predicted, ratings) if counted is None else counted
    unseen = F.col("predictions") - F.col("watched")
    out = _row(
        users.join(counted, "userId", "left").agg(
            F.count("*").alias("usersProcessed"), F.count_if(F.col("predictions").isNull()).alias("usersWithoutPredictions"), F.coalesce(F.sum("predictions"), F.lit(0)).alias("rawPredictionRows"),
            F.coalesce(F.sum("watched"), F.lit(0)).alias("predictionsFilteredAsWatched"), F.coalesce(F.sum(unseen), F.lit(0)).alias("unseenCandidatesConsidered"), F.count_if(unseen == 0).alias("usersWithNoUnseenCandidates"),
        ),
        recommended.agg(F.count("*").alias("recommendationsEmitted"), F.count_distinct("userId").alias("usersEmitted")),
    )
    return out.withColumn("candidatesDiscardedByTopK", F.col("unseenCandidatesConsidered") - F.col("recommendationsEmitted"))
