"""The relations, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


RATINGS = _schema("userId long, movieId long, rating int, date date")
RATINGS_TS = _schema("userId long, movieId long, rating int, timestamp long, dateTimeUtc string, date string")
HISTORY = T.StructType([T.StructField("userId", T.LongType()), T.StructField("ratings", T.ArrayType(_schema("movieId long, rating int")))])
PAIR_STATS = _schema("movieI long, movieJ long, commonUsers long, sumXY long, sumX2 long, sumY2 long")
SIMILARITY = _schema("sourceId long, neighborId long, similarity double, commonUsers long")
PREDICTIONS = _schema("userId long, movieId long, score double")
RECOMMENDATIONS = _schema("userId long, rank int, movieId long, score double")
METADATA = _schema("movieId long, title string, year int, genres string")
USERS = _schema("userId long, gender string, age int, occupation int, zip string")

#: Header lines of the CSV relations, compared exactly.
RATINGS_HEADER = "userId,movieId,rating,date"
RATINGS_TS_HEADER = "userId,movieId,rating,timestamp,dateTimeUtc,date"
RATINGS_UNDATED_HEADER = "userId,movieId,rating"
NEIGHBORS_HEADER = "movieId,neighborMovieId,similarity,commonUsers"
RECOMMENDATIONS_HEADER = "userId,rank,movieId,score"

#: The columns of a benchmark result, by kind.
BENCH_TEXT = "experimentId profile datasetType method".split()
BENCH_SIZES = "seed users items ratingsPerUser ratingsRows trainRows testRows minCommonUsers topL topK relevanceThreshold reducers repetition".split()
BENCH_SECONDS = "datasetGenerationSeconds splitSeconds userHistorySeconds pairStatisticsSeconds similaritySeconds scoringSeconds topKSeconds evaluationSeconds totalPipelineSeconds totalRunSeconds".split()
BENCH_ROWS = "userHistoryRows itemPairRows similarityRows rawPredictionRows recommendationUsers recommendationItems".split()
BENCH_BYTES = "ratingsInputBytes trainBytes userHistoryBytes itemPairBytes similarityBytes rawPredictionBytes recommendationBytes".split()
BENCH_METRICS = "predictionCoverage mae rmse precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK".split()
BENCH_STATUS = "status errorStage errorMessage".split()
BENCH_COLUMNS = BENCH_TEXT + BENCH_SIZES + BENCH_SECONDS + BENCH_ROWS + BENCH_BYTES + BENCH_METRICS + BENCH_STATUS
#: Stages of a pipeline, in order; data generation and split stand before them.
STAGE_SECONDS = BENCH_SECONDS[1:8]
