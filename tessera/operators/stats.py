"""Statistics of datasets, runs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """(rating, ratings) in numeric order."""
    return ratings.groupBy("rating").agg(F.count("*").alias("ratings")).orderBy("rating")


def _spread(ratings: DataFrame, key: str, names: tuple[str, str, str, str]) -> DataFrame:
    counts = ratings.groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias(names[0]), F.min("c").alias(names[1]), F.max("c").alias(names[2]), F.avg("c").alias(names[3]))


def dataset(ratings: DataFrame, time: str | None = None) -> DataFrame:
    """One row: sizes, ranges, ratings per user and per movie, and the time range if there is one."""
    times = [F.min(time).alias("minimumTime"), F.max(time).alias("maximumTime")] if time else []
    base = ratings.agg(
        F.count("*").alias("ratingRows"), F.min("userId").alias("minimumUserId"), F.max("userId").alias("maximumUserId"), F.min("movieId").alias("minimumMovieId"),
        F.max("movieId").alias("maximumMovieId"), F.min("rating").alias("minimumRating"), F.max("rating").alias("maximumRating"), *times,
    )
    users = _spread(ratings, "userId", ("distinctUsers", "ratingsPerUserMinimum", "ratingsPerUserMaximum", "ratingsPerUserAverage"))
    movies = _spread(ratings, "movieId", ("distinctRatedMovies", "ratingsPerMovieMinimum", "ratingsPerMovieMaximum", "ratingsPerMovieAverage"))
    return base.crossJoin(users).crossJoin(movies)


def ratings_per_movie(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.count("*").alias("ratings"))


def metadata_coverage(ratings: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: rated movies, those with metadata, and their share."""
    rated = ratings.select("movieId").distinct().join(metadata.select("movieId", F.lit(1).alias("known")).distinct(), "movieId", "left")
    return rated.agg(F.count("*").alias("ratedMovies"), F.count("known").alias("withMetadata"), F.try_divide(F.count("known").cast("double"), F.count("*").cast("double")).alias("metadataCoverage"))


def official(ratings: DataFrame, rows: int = 1_000_209, users: int = 6_040, least: int = 20) -> None:
    """Fails unless the counts are those of the published one-million dataset."""
    found = dataset(ratings).first()
    wanted = {"ratingRows": rows, "distinctUsers": users, "minimumRating": 1, "maximumRating": 5}
    wrong = {k: found[k] for k, v in wanted.items() if found[k] != v}
    if wrong or found.ratingsPerUserMinimum < least:
        raise ValueError(f"not the official counts: {wrong or found.ratingsPerUserMinimum}")


def synthetic(ratings: DataFrame) -> DataFrame:
    """One row about a generated or external set, dates included."""
    return dataset(ratings, "date")


def run(pairs: DataFrame | None, ratings: DataFrame, eligible: DataFrame, before: DataFrame, after: DataFrame, recommended: DataFrame, pair_rows: DataFrame | None = None) -> DataFrame:
    """One row about a model run; ``pair_rows``: the number of pairs, if it is at hand."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    base = ratings.agg(F.count("*").alias("acceptedRatings"), F.count_distinct("userId").alias("users"), F.count_distinct("movieId").alias("items"))
    recs = recommended.agg(F.count_distinct("userId").alias("usersWithRecommendations"), F.count("*").alias("recommendationRows"))
    out = base
    for df in (count(pairs, "unorderedItemPairs") if pair_rows is None else pair_rows.toDF("unorderedItemPairs"), count(eligible, "eligibleUnorderedItemPairs"), count(before, "directedEntriesBeforeTopL"), count(after, "directedEntriesAfterTopL"), recs):
        out = out.crossJoin(df)
    return out


def lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row: the number of text records, blank ones included."""
    return texts.agg(F.count("*").alias("lineCount"))


def list_items(text_lines: DataFrame) -> DataFrame:
    """One row: rows of a list output, the entries in them, and their bytes."""
    entries = F.size(F.filter(F.split(F.split_part("value", F.lit("\t"), F.lit(2)), ","), lambda x: x.contains(":")))
    return text_lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(entries), F.lit(0)).alias("items"), text_bytes())


def text_bytes(column: str = "value") -> Column:
    """``bytes``: the size of text lines as UTF-8, each with its line feed."""
    return F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0)).cast("long").alias("bytes")
