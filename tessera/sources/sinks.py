"""Writers of the text, CSV and JSON relations. Outputs that exist are an error."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from tessera import schemas
from tessera.functions.numbers import ten_text


def history_lines(ratings: DataFrame) -> DataFrame:
    """(value): ``user<TAB>movie:rating,...`` by movie id."""
    entries = F.sort_array(F.collect_list(F.struct("movieId", "rating")))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["movieId"].cast("string"), e["rating"].cast("string"))), ",")
    return ratings.groupBy("userId").agg(text.alias("text")).select("userId", F.concat_ws("\t", F.col("userId").cast("string"), "text").alias("value"))


def csv_lines(ratings: DataFrame) -> DataFrame:
    """(value): normalized ratings, without their header."""
    return ratings.select(F.concat_ws(",", *[F.col(c).cast("string") for c in schemas.RATINGS_HEADER.split(",")]).alias("value"))


def _keyed(rows: DataFrame, *values: Column) -> DataFrame:
    """(value): ``a,b<TAB>value,...`` of the first two columns and the texts of the values."""
    a, b = [F.col(c).cast("string") for c in rows.columns[:2]]
    parts = [a, F.lit(","), b, F.lit("\t"), *[x for v in values for x in (v, F.lit(","))][:-1]]
    return rows.select(F.concat(*[F.coalesce(p, F.lit("null")) for p in parts]).alias("value"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    return _keyed(pairs.select(*schemas.PAIR_STATS.names), *[F.col(c).cast("string") for c in schemas.PAIR_STATS.names[2:]])


def similarity_lines(relations: DataFrame) -> DataFrame:
    return _keyed(relations.select("sourceId", "neighborId", "similarity", "commonUsers"), ten_text(F.col("similarity")), F.col("commonUsers").cast("string"))


def prediction_lines(predicted: DataFrame) -> DataFrame:
    return _keyed(predicted.select("userId", "movieId", "score"), ten_text(F.col("score")))


def recommendation_lines(recommended: DataFrame) -> DataFrame:
    """(userId, value): ``user<TAB>movie:score,...`` by rank."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "movieId", "score")))
    text = F.array_join(F.transform(entries, lambda e: F.format_string("%d:%.10f", e["movieId"], e["score"])), ",")
    return recommended.groupBy("userId").agg(text.alias("text")).select("userId", F.concat_ws("\t", F.col("userId").cast("string"), "text").alias("value"))


def write_text(lines: DataFrame, path: str, one_file: bool = False, compressed: bool = False, quick: bool = False) -> None:
    """The column ``value`` as text; ``one_file`` merges the parts, ``compressed`` writes them with gzip, ``quick`` at its fastest level."""
    texts = (lines.select("value").coalesce(1) if one_file else lines.select("value")).write.mode("errorifexists").option("compression", "gzip" if compressed else "none")
    (texts.option("zlib.compress.level", "BEST_SPEED") if quick else texts).text(path)


def write_csv(rows: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """A CSV with a header, blank for null, in the given order over its part files; ``one_file`` sorts them into one, for small results."""
    (rows.coalesce(1).sortWithinPartitions(*order) if one_file else rows.orderBy(*order)).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def ratings_csv(ratings: DataFrame) -> DataFrame:
    return ratings.select(*schemas.RATINGS_HEADER.split(","))


def neighbors_csv(relations: DataFrame, decimals: int = 12) -> DataFrame:
    return relations.select(F.col("sourceId").alias("movieId"), F.col("neighborId").alias("neighborMovieId"), F.format_string(f"%.{decimals}f", "similarity").alias("similarity"), "commonUsers")


def recommendations_csv(recommended: DataFrame, decimals: int = 12) -> DataFrame:
    return recommended.select("userId", "rank", "movieId", F.format_string(f"%.{decimals}f", "score").alias("score"))


def download_csv(recommended: DataFrame, user: int) -> DataFrame:
    """A user's recommendations with titles, for download."""
    return recommended.where(F.col("userId") == user).select("rank", "movieId", "title", "year", "genres", ten_text(F.col("score")).alias("predictedScore"))


def metrics_json(metrics: DataFrame) -> str:
    """The one row as JSON with sorted keys; a number that is not finite is an error."""
    row = metrics.first().asDict()
    for name, value in row.items():
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError(f"{name} is not finite")
    return json.dumps(row, indent=2, sort_keys=True, allow_nan=False) + "\n"


#: The metric columns of the CSV form, and the fields they come from.
METRIC_COLUMNS = dict(zip(
    "k relevanceThreshold testRows matchedPredictions predictionCoverage mae rmse rankingEligibleUsers hits precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK".split(),
    "k relevance_threshold test_rows matched_test_predictions prediction_coverage mae rmse ranking_eligible_users ranking_hits precision_at_k recall_at_k hit_rate_at_k ndcg_at_k mrr_at_k".split(),
    strict=True,
))


def metrics_csv(metrics: DataFrame, method: str) -> DataFrame:
    text = lambda c: F.when(F.col(c).isNotNull(), ten_text(F.col(c))) if dict(metrics.dtypes)[c] == "double" else F.col(c)
    return metrics.select(F.lit(method).alias("method"), *[text(c).alias(name) for name, c in METRIC_COLUMNS.items()])


def per_user_csv(users: DataFrame) -> DataFrame:
    """Diagnostics with ten decimals, blank for null."""
    text = lambda c: F.when(F.col(c).isNotNull(), ten_text(F.col(c))).alias(c)
    return users.select(*[text(c) if kind == "double" else F.col(c) for c, kind in users.dtypes])


#: The columns of the report's tables.
METHOD_TABLES = {
    "rating_metrics": "method predictionCoverage mae rmse matchedPredictions missingPredictions".split(),
    "ranking_metrics": "method precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK".split(),
    "runtime_comparison": "method userHistorySeconds pairStatisticsSeconds similaritySeconds scoringSeconds topKSeconds evaluationSeconds totalPipelineSeconds".split(),
}
STAGE_TABLE = "stage status elapsedSeconds outputRows outputBytes".split()
#: Fields of the dataset and split tables, and the statistics that they come from.
DATASET_FIELDS = {"ratingsRows": "ratingRows", "users": "distinctUsers", "ratedMovies": "distinctRatedMovies"}
SPLIT_FIELDS = {"trainRows": "trainRows", "testRows": "testRows", "trainTestOverlapRows": "trainTestOverlapRows"}


def report_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A report's table of a row per method or stage: the named columns as text, blank where there is none."""
    blank = F.lit("")
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), blank) if c in rows.columns else blank).alias(c) for c in columns])


def fact_table(row: DataFrame, fields: dict[str, str], source: str) -> DataFrame:
    """(field, value, source) of a one-row relation, a row per field; blank where there is no value."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in row.columns else F.lit("")
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), value(c).alias("value"), F.lit(source).alias("source")) for name, c in fields.items()])))
