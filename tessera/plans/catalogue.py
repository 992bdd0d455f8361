"""Every query of the recommendation engine by name, with the SQL that checks it.

The driver's tables hold no ratings; the view ``ratings`` takes each order line as one: customer and part are
user and movie, the quantity gives 1 to 5, and of several lines for a (user, movie) the latest, then the
highest, counts. Model queries use ``CONFIG``; part stands in for movie metadata, and customer for results of
benchmark runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.config import ModelConfig
from tessera.operators import benchmarks, evaluate, pairs, scoring, similarity, split, stats, topk, views
from tessera.plans import model, shared
from tessera.sources import sinks

CONFIG = ModelConfig(method="cosine", min_common_users=2, top_l=50, top_k=10, relevance_threshold=4)
COOCCURRENCE = replace(CONFIG, method="cooccurrence")
FULL = replace(CONFIG, precision="full")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, of: Callable[[str], Column] | None = None, sent: bool = False) -> DataFrame:
    """(userId, movieId, rating, ts), of the customers that ``of`` holds for; ``sent`` broadcasts their orders."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders if of is None else orders.where(of("o_custkey"))
    orders = F.broadcast(orders) if sent else orders
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    each = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") + 1).alias("userId"), (F.col("l_partkey") + 1).alias("movieId"), F.col("o_orderdate").alias("ts"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating")
    )
    best = each.groupBy("userId", "movieId").agg(F.max(F.struct("ts", "rating")).alias("best"))
    return best.select("userId", "movieId", "best.rating", "best.ts")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ratings`` as a table that is written once, in passes over the customers: the model's plans read it several times."""

    def write(path: str) -> None:
        rows = _table(spark, sf_dir, "orders").count()
        n = max(1, min(shared.MOST_PASSES, -(-rows // shared.SENT_ROWS)))
        for i in range(n):
            shared.put(ratings(spark, sf_dir, shared.share(n, i), rows <= n * shared.SENT_ROWS), f"{path}/pass-{i}")

    return spark.read.parquet(shared.once(spark, write, sf_dir, "ratings") + "/pass-*")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") + 1).alias("movieId"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).alias("year"), F.concat_ws("|", "p_brand", "p_type").alias("genres"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as benchmark runs."""
    key, money = F.col("c_custkey"), F.abs("c_acctbal")
    stage = lambda i: F.when(key % (i + 5) != 0, F.floor(money * 100 / (i + 1)).cast("double"))
    names = "splitSeconds userHistorySeconds pairStatisticsSeconds similaritySeconds scoringSeconds topKSeconds evaluationSeconds".split()
    return _table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("experimentId"), F.col("c_mktsegment").alias("profile"), F.when(key % 2 == 0, "cosine").otherwise("cooccurrence").alias("method"), F.lit(1).alias("repetition"),
        ((key % 7 + 1) * 1000).alias("ratingsRows"), (key % 7 * 100).alias("testRows"), (key % 11 * 500).alias("itemPairRows"), (key % 13 * 50).alias("similarityRows"), (key % 5 * 20).alias("recommendationUsers"),
        F.when(key % 10 == 0, "failed").otherwise("completed").alias("status"), F.when(key % 9 != 0, money).alias("totalPipelineSeconds"),
        *[F.when(key % 3 != 0, (key % 10) / F.lit(10.0)).alias(c) for c in "predictionCoverage precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK".split()], *[stage(i).alias(n) for i, n in enumerate(names)],
    )


def _fit(spark: SparkSession, sf_dir: str, config: ModelConfig) -> model.Model:
    return model.fit(rated(spark, sf_dir).select("userId", "movieId", "rating"), config)


def split_model(spark: SparkSession, sf_dir: str) -> tuple[model.Model, DataFrame, DataFrame]:
    """The model of the training ratings, its predictions (a table written once, as the evaluation reads them three times), and the test ratings."""
    train, test = split.leave_one_out(rated(spark, sf_dir), "ts")
    fitted = model.fit(train.select("userId", "movieId", "rating"), CONFIG)
    return fitted, shared.table(spark, fitted.predictions, sf_dir, "split-predictions"), test.select("userId", "movieId", "rating")


# ---- SQL parts -------------------------------------------------------------------------------------------

RATINGS_SQL = """ratings AS (
    SELECT u AS userId, m AS movieId, r AS rating, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY u, m ORDER BY ts DESC, r DESC) AS k FROM (
            SELECT o_custkey + 1 AS u, l_partkey + 1 AS m, CAST(ceil(l_quantity / 10) AS INTEGER) AS r, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        )
    ) WHERE k = 1
)"""
PAIRS_SQL = """pairs AS (
    SELECT a.movieId AS movieI, b.movieId AS movieJ, count(*) AS commonUsers, CAST(sum(a.rating * b.rating) AS BIGINT) AS sumXY,
           CAST(sum(a.rating * a.rating) AS BIGINT) AS sumX2, CAST(sum(b.rating * b.rating) AS BIGINT) AS sumY2
    FROM train a JOIN train b ON a.userId = b.userId AND a.movieId < b.movieId GROUP BY 1, 2
)"""
TRAIN_ALL = "train AS (SELECT userId, movieId, rating FROM ratings)"
SPLIT_SQL = """marked AS (
    SELECT *, row_number() OVER (PARTITION BY userId ORDER BY ts DESC, movieId DESC) AS place, count(*) OVER (PARTITION BY userId) AS n FROM ratings
), train AS (SELECT userId, movieId, rating, ts FROM marked WHERE NOT (place = 1 AND n >= 2)),
test AS (SELECT userId, movieId, rating, ts FROM marked WHERE place = 1 AND n >= 2)"""


def _relations_sql(config: ModelConfig) -> str:
    pruned = f"""relations AS (
        SELECT sourceId, neighborId, similarity, commonUsers, CAST(CAST(similarity AS DECIMAL(12,10)) * 10000000000 AS BIGINT) AS sim10 FROM (
            SELECT *, row_number() OVER (PARTITION BY sourceId ORDER BY similarity DESC, neighborId) AS place FROM scored
        ) WHERE place <= {config.top_l}
    )"""
    both = f"""kept AS (SELECT * FROM pairs WHERE commonUsers >= {config.min_common_users}),
    both_ways AS (SELECT movieI AS sourceId, movieJ AS neighborId, * FROM kept UNION ALL SELECT movieJ, movieI, * FROM kept)"""
    if config.method == "cosine":
        scored = "scored AS (SELECT sourceId, neighborId, sumXY / sqrt(CAST(sumX2 AS DOUBLE) * CAST(sumY2 AS DOUBLE)) AS similarity, commonUsers FROM both_ways)"
    else:
        scored = "scored AS (SELECT sourceId, neighborId, commonUsers / CAST(sum(commonUsers) OVER (PARTITION BY sourceId) AS DOUBLE) AS similarity, commonUsers FROM both_ways)"
    return f"{both}, {scored}, {pruned}"


def _predictions_sql(config: ModelConfig) -> str:
    if config.precision == "full":
        return """predicted AS (
            SELECT r.userId, s.neighborId AS movieId, sum(s.similarity * r.rating) / sum(s.similarity) AS score FROM train r JOIN relations s ON r.movieId = s.sourceId GROUP BY 1, 2
        )"""
    return """predicted AS (
        SELECT r.userId, s.neighborId AS movieId, round(CAST(sum(s.sim10 * r.rating) AS DOUBLE) / CAST(sum(s.sim10) AS DOUBLE), 10) AS score
        FROM train r JOIN relations s ON r.movieId = s.sourceId GROUP BY 1, 2
    )"""


def _top_sql(config: ModelConfig) -> str:
    return f"""recommended AS (
        SELECT userId, CAST(place AS INTEGER) AS rank, movieId, score FROM (
            SELECT p.*, row_number() OVER (PARTITION BY p.userId ORDER BY score DESC, p.movieId) AS place FROM predicted p
            WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.userId = p.userId AND t.movieId = p.movieId)
        ) WHERE place <= {config.top_k}
    )"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((RATINGS_SQL, *parts)) + "\n"


def _model_sql(config: ModelConfig, training: str = TRAIN_ALL) -> tuple[str, ...]:
    return training, PAIRS_SQL, _relations_sql(config), _predictions_sql(config), _top_sql(config)


METADATA_SQL = "metadata AS (SELECT p_partkey + 1 AS movieId, p_name AS title, p_size + 1950 AS year, p_brand || '|' || p_type AS genres FROM part)"
_metric = lambda c: f"CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 10) / CAST(10 AS DOUBLE) END AS {c}"
_stage = lambda i, n: f"CASE WHEN c_custkey % {i + 5} <> 0 THEN floor(abs(c_acctbal) * 100 / {i + 1}) END AS {n}"
_STAGES = "splitSeconds userHistorySeconds pairStatisticsSeconds similaritySeconds scoringSeconds topKSeconds evaluationSeconds".split()
RUNS_SQL = f"""runs AS (
    SELECT c_name AS experimentId, c_mktsegment AS profile, CASE WHEN c_custkey % 2 = 0 THEN 'cosine' ELSE 'cooccurrence' END AS method, 1 AS repetition, (c_custkey % 7 + 1) * 1000 AS ratingsRows,
           c_custkey % 7 * 100 AS testRows, c_custkey % 11 * 500 AS itemPairRows, c_custkey % 13 * 50 AS similarityRows, c_custkey % 5 * 20 AS recommendationUsers,
           CASE WHEN c_custkey % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN c_custkey % 9 <> 0 THEN abs(c_acctbal) END AS totalPipelineSeconds,
           {', '.join(map(_metric, 'predictionCoverage precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK'.split()))}, {', '.join(_stage(i, n) for i, n in enumerate(_STAGES))}
    FROM customer
)"""
PER_USER_SQL = """sizes AS (SELECT userId, count(*) AS n FROM recommended GROUP BY 1), users AS (
    SELECT t.userId, t.movieId AS testMovieId, t.rating AS actualRating, p.score AS predictedScore, abs(p.score - t.rating) AS absoluteError, (p.score - t.rating) * (p.score - t.rating) AS squaredError,
           t.rating >= 4 AS isRelevant, r.rank AS recommendationRank, CAST(t.rating >= 4 AND r.rank IS NOT NULL AS INTEGER) AS hit,
           CASE WHEN t.rating >= 4 AND r.rank IS NOT NULL THEN 1 / log2(r.rank + 1) ELSE 0 END AS ndcg, CASE WHEN t.rating >= 4 AND r.rank IS NOT NULL THEN 1 / CAST(r.rank AS DOUBLE) ELSE 0 END AS mrr,
           coalesce(s.n, 0) AS recommendationCount
    FROM test t LEFT JOIN predicted p ON p.userId = t.userId AND p.movieId = t.movieId LEFT JOIN recommended r ON r.userId = t.userId AND r.movieId = t.movieId LEFT JOIN sizes s ON s.userId = t.userId
)"""


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _round_sql(columns: str, rounded: str, digits: int = 9) -> str:
    kept = columns.split()
    return ", ".join([f"round({c}, {digits}) AS {c}" if c in rounded.split() else c for c in kept])


# ---- ratings, histories, pairs ---------------------------------------------------------------------------

_add("ratings_view", lambda s, d: ratings(s, d).select("userId", "movieId", "rating"), _with() + "SELECT userId, movieId, rating FROM ratings")
_add("rating_distribution", lambda s, d: stats.rating_distribution(rated(s, d)), _with() + "SELECT rating, count(*) AS ratings FROM ratings GROUP BY 1")
_add(
    "dataset_stats", lambda s, d: _rounded(stats.dataset(rated(s, d)), "ratingsPerUserAverage", "ratingsPerMovieAverage"),
    _with("u AS (SELECT count(*) AS c FROM ratings GROUP BY userId)", "m AS (SELECT count(*) AS c FROM ratings GROUP BY movieId)") + """
    SELECT count(*) AS ratingRows, min(userId) AS minimumUserId, max(userId) AS maximumUserId, min(movieId) AS minimumMovieId, max(movieId) AS maximumMovieId, min(rating) AS minimumRating, max(rating) AS maximumRating,
           (SELECT count(*) FROM u) AS distinctUsers, (SELECT min(c) FROM u) AS ratingsPerUserMinimum, (SELECT max(c) FROM u) AS ratingsPerUserMaximum, (SELECT round(avg(c), 9) FROM u) AS ratingsPerUserAverage,
           (SELECT count(*) FROM m) AS distinctRatedMovies, (SELECT min(c) FROM m) AS ratingsPerMovieMinimum, (SELECT max(c) FROM m) AS ratingsPerMovieMaximum, (SELECT round(avg(c), 9) FROM m) AS ratingsPerMovieAverage
    FROM ratings""",
)
_add("ratings_per_movie", lambda s, d: stats.ratings_per_movie(rated(s, d)), _with() + "SELECT movieId, count(*) AS ratings FROM ratings GROUP BY 1")
_add("user_history_long", lambda s, d: pairs.long_form(pairs.histories(rated(s, d))), _with() + "SELECT userId, movieId, rating FROM ratings")
_HISTORY_SQL = "SELECT userId, userId || chr(9) || string_agg(movieId || ':' || rating, ',' ORDER BY movieId) AS value FROM ratings GROUP BY userId"
_add("user_history_text", lambda s, d: sinks.history_lines(rated(s, d)), _with() + _HISTORY_SQL)
_add(
    "pair_contribution_estimate", lambda s, d: pairs.pair_estimate(rated(s, d)),
    _with("u AS (SELECT count(*) AS c FROM ratings GROUP BY userId)") + "SELECT count(*) AS users, count(*) FILTER (c = 1) AS singleItemUsers, CAST(coalesce(sum(c * (c - 1) // 2), 0) AS BIGINT) AS pairContributions FROM u",
)
_PAIR_COLUMNS = "movieI, movieJ, commonUsers, sumXY, sumX2, sumY2"
_add("pair_stats", lambda s, d: pairs.pair_statistics(rated(s, d)), _with(TRAIN_ALL, PAIRS_SQL) + f"SELECT {_PAIR_COLUMNS} FROM pairs")
_add("pair_stats_min_support", lambda s, d: similarity.supported(pairs.pair_statistics(rated(s, d)), 2), _with(TRAIN_ALL, PAIRS_SQL) + f"SELECT {_PAIR_COLUMNS} FROM pairs WHERE commonUsers >= 2")
_add(
    "pair_text", lambda s, d: sinks.pair_lines(similarity.supported(pairs.pair_statistics(rated(s, d)), 2)),
    _with(TRAIN_ALL, PAIRS_SQL) + "SELECT format('{},{}', movieI, movieJ) || chr(9) || format('{},{},{},{}', commonUsers, sumXY, sumX2, sumY2) AS value FROM pairs WHERE commonUsers >= 2",
)

# ---- similarity ------------------------------------------------------------------------------------------

for _config, _name in ((CONFIG, "cosine"), (COOCCURRENCE, "cooccurrence")):
    _add(
        f"sim_{_name}_topl", lambda s, d, c=_config: _rounded(_fit(s, d, c).relations.drop("sim10"), "similarity", digits=10),
        _with(TRAIN_ALL, PAIRS_SQL, _relations_sql(_config)) + "SELECT sourceId, neighborId, round(similarity, 10) AS similarity, commonUsers FROM relations",
    )
    _add(
        f"raw_predictions_{_name}", lambda s, d, c=_config: _fit(s, d, c).predictions(),
        _with(*_model_sql(_config)[:-1]) + "SELECT userId, movieId, score FROM predicted",
    )
    _add(f"topk_{_name}", lambda s, d, c=_config: _fit(s, d, c).recommendations(), _with(*_model_sql(_config)) + "SELECT userId, rank, movieId, score FROM recommended")
_add(
    "similarity_directed", lambda s, d: _rounded(similarity.best_per_relation(similarity.cosine(similarity.supported(pairs.pair_statistics(rated(s, d)), 2))), "similarity"),
    _with(TRAIN_ALL, PAIRS_SQL, _relations_sql(CONFIG)) + "SELECT sourceId, neighborId, round(similarity, 9) AS similarity, commonUsers FROM scored",
)
_add(
    "cooccurrence_row_sums",
    lambda s, d: similarity.cooccurrence(similarity.supported(pairs.pair_statistics(rated(s, d)), 2)).groupBy("sourceId").agg(F.round(F.sum("similarity"), 9).alias("rowSum"), F.sum("commonUsers").alias("denominator")),
    _with(TRAIN_ALL, PAIRS_SQL, _relations_sql(COOCCURRENCE)) + "SELECT sourceId, round(sum(similarity), 9) AS rowSum, CAST(sum(commonUsers) AS BIGINT) AS denominator FROM scored GROUP BY 1",
)

# ---- ranking ---------------------------------------------------------------------------------------------

_add(
    "topk_full_precision", lambda s, d: _rounded(_fit(s, d, FULL).recommendations().groupBy("userId").agg(F.count("*").alias("n"), F.avg("score").alias("meanScore"), F.max("score").alias("bestScore")), "meanScore", "bestScore"),
    _with(*_model_sql(FULL)) + "SELECT userId, count(*) AS n, round(avg(score), 9) AS meanScore, round(max(score), 9) AS bestScore FROM recommended GROUP BY 1",
)
_add(
    "topk_text", lambda s, d: sinks.recommendation_lines(_fit(s, d, CONFIG).recommendations()),
    _with(*_model_sql(CONFIG)) + "SELECT userId, userId || chr(9) || string_agg(movieId || ':' || printf('%.10f', score), ',' ORDER BY rank) AS value FROM recommended GROUP BY userId",
)
#: Histories before a date: users who came later have predictions and none of them.
EARLY = "1995-04-01"
_add(
    "prediction_user_without_history", lambda s, d: topk.without_history(_fit(s, d, CONFIG).predictions(), rated(s, d).where(F.col("ts") < EARLY)),
    _with(*_model_sql(CONFIG)[:-1]) + f"SELECT DISTINCT userId FROM predicted WHERE userId NOT IN (SELECT userId FROM ratings WHERE ts < '{EARLY}')",
)

# ---- splits ----------------------------------------------------------------------------------------------

for _by, _sql in (("ts", SPLIT_SQL), ("item", SPLIT_SQL.replace("ts DESC, movieId DESC", "movieId DESC"))):
    for _i, _part in enumerate(("train", "test")):
        _name = f"split_{_part}" if _by == "ts" else f"split_by_item_{_part}"
        _add(_name, lambda s, d, b=_by, i=_i: split.leave_one_out(rated(s, d), b)[i].select("userId", "movieId", "rating"), _with(_sql) + f"SELECT userId, movieId, rating FROM {_part}")
_add(
    "split_stats", lambda s, d: _rounded(split.statistics(*split.leave_one_out(rated(s, d), "ts")), "avgTrainRatingsPerUser", "trainPercentage", "testPercentage"),
    _with(SPLIT_SQL, "u AS (SELECT count(*) AS c FROM train GROUP BY userId)") + """
    SELECT (SELECT count(*) FROM train) AS trainRows, (SELECT count(*) FROM u) AS trainUsers, (SELECT min(c) FROM u) AS minTrainRatingsPerUser, (SELECT max(c) FROM u) AS maxTrainRatingsPerUser,
           (SELECT round(avg(c), 9) FROM u) AS avgTrainRatingsPerUser, (SELECT count(*) FROM test) AS testRows, (SELECT count(DISTINCT movieId) FROM test) AS testItems, (SELECT count(DISTINCT movieId) FROM train) AS trainItems,
           (SELECT count(DISTINCT movieId) FROM test WHERE movieId NOT IN (SELECT movieId FROM train)) AS coldStartTestItems,
           (SELECT count(*) FROM test e JOIN train t ON t.userId = e.userId AND t.movieId = e.movieId) AS trainTestOverlapRows, count(*) AS inputRatings,
           round((SELECT count(*) FROM train) / CAST(count(*) AS DOUBLE), 9) AS trainPercentage, round((SELECT count(*) FROM test) / CAST(count(*) AS DOUBLE), 9) AS testPercentage,
           (SELECT count(*) FROM u) - (SELECT count(*) FROM test) AS usersWithoutTest
    FROM ratings""",
)
_ITEM_SQL = SPLIT_SQL.replace("ts DESC, movieId DESC", "movieId DESC")
_TIME_SQL = SPLIT_SQL.replace("marked", "marked_by_time").replace("train AS", "train_by_time AS").replace("test AS", "test_by_time AS")
# the split by item holds out each user's highest movie, so movies that are everybody's highest are cold
_add("cold_start_items", lambda s, d: split.cold_start_items(*split.leave_one_out(rated(s, d), "item")), _with(_ITEM_SQL) + "SELECT DISTINCT movieId FROM test WHERE movieId NOT IN (SELECT movieId FROM train)")
_add(
    "train_test_overlap", lambda s, d: split.overlap(split.leave_one_out(rated(s, d), "ts")[0], split.leave_one_out(rated(s, d), "item")[1]),
    _with(_ITEM_SQL, _TIME_SQL) + "SELECT userId, movieId FROM train_by_time INTERSECT SELECT userId, movieId FROM test",
)
_add(
    "late_training_users", lambda s, d: split.late_training(*split.leave_one_out(rated(s, d), "item"), "ts").select("userId"),
    _with(_ITEM_SQL) + "SELECT t.userId FROM test t JOIN (SELECT userId, max(ts) AS last FROM train GROUP BY 1) l ON l.userId = t.userId WHERE last > t.ts",
)

# ---- evaluation ------------------------------------------------------------------------------------------


def evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, per-user diagnostics)."""
    fitted, predicted, test = split_model(spark, sf_dir)
    return fitted.evaluation(test, predicted)


_USER_COLUMNS = "userId testMovieId actualRating predictedScore absoluteError squaredError isRelevant recommendationRank hit ndcg mrr recommendationCount"
#: The logarithm alone may differ in its last digit; scores have ten decimals, so errors would be ties of a rounding.
_USER_ROUNDED = "ndcg"
_add("per_user_metrics", lambda s, d: _rounded(evaluation(s, d)[1], *_USER_ROUNDED.split()), _with(*_model_sql(CONFIG, SPLIT_SQL), PER_USER_SQL) + f"SELECT {_round_sql(_USER_COLUMNS, _USER_ROUNDED)} FROM users")


METRICS_ROUNDED = "prediction_coverage mae rmse recommendation_user_coverage precision_at_k recall_at_k hit_rate_at_k ndcg_at_k mrr_at_k".split()
_mean_sql = lambda c, name: f"round(coalesce(avg({c}) FILTER (isRelevant), 0), 9) AS {name}"
_add(
    "eval_metrics", lambda s, d: _rounded(evaluation(s, d)[0], *METRICS_ROUNDED),
    _with(*_model_sql(CONFIG, SPLIT_SQL), PER_USER_SQL) + f"""
    SELECT 'leave-one-out-by-time' AS evaluation_method, 10 AS k, 4 AS relevance_threshold, count(*) AS test_rows, count(predictedScore) AS matched_test_predictions, count(*) - count(predictedScore) AS missing_test_predictions,
           round(count(predictedScore) / CAST(count(*) AS DOUBLE), 9) AS prediction_coverage, round(avg(absoluteError), 9) AS mae, round(sqrt(avg(squaredError)), 9) AS rmse, count(*) FILTER (isRelevant) AS ranking_eligible_users,
           CAST(sum(hit) AS BIGINT) AS ranking_hits, count(*) FILTER (recommendationCount > 0) AS users_with_recommendations, round(count(*) FILTER (recommendationCount > 0) / CAST(count(*) AS DOUBLE), 9) AS recommendation_user_coverage,
           {_mean_sql('hit / CAST(10 AS DOUBLE)', 'precision_at_k')}, {_mean_sql('CAST(hit AS DOUBLE)', 'recall_at_k')}, {_mean_sql('CAST(hit AS DOUBLE)', 'hit_rate_at_k')}, {_mean_sql('ndcg', 'ndcg_at_k')}, {_mean_sql('mrr', 'mrr_at_k')},
           (SELECT count(*) FROM recommended r JOIN train t ON t.userId = r.userId AND t.movieId = r.movieId) AS watched_recommendations_found,
           (SELECT count(*) FROM test e JOIN train t ON t.userId = e.userId AND t.movieId = e.movieId) AS train_test_overlap_rows
    FROM users""",
)
_add(
    "watched_violations", lambda s, d: evaluate.watched_violations(topk.ranked(_fit(s, d, CONFIG).predictions(), 3), rated(s, d)).select("userId", "movieId", "rank"),
    _with(*_model_sql(CONFIG)[:-1]) + """SELECT p.userId, p.movieId, CAST(place AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS place FROM predicted) p
    JOIN ratings r ON r.userId = p.userId AND r.movieId = p.movieId WHERE place <= 3""",
)

# ---- views -----------------------------------------------------------------------------------------------

_add(
    "recommendations_enriched", lambda s, d: views.titled(_fit(s, d, CONFIG).recommendations(), metadata(s, d)),
    _with(*_model_sql(CONFIG), METADATA_SQL) + "SELECT r.userId, r.rank, r.movieId, r.score, coalesce(title, 'Movie ' || r.movieId) AS title, year, coalesce(genres, '') AS genres FROM recommended r LEFT JOIN metadata m ON m.movieId = r.movieId",
)
_add(
    "user_summary", lambda s, d: _rounded(views.user_summary(rated(s, d), _fit(s, d, CONFIG).recommendations()), "averageHistoricalRating", "averageRecommendationScore"),
    _with(*_model_sql(CONFIG)) + """SELECT h.userId, h.n AS watchedMovieCount, coalesce(r.n, 0) AS recommendationCount, h.a AS averageHistoricalRating, r.a AS averageRecommendationScore, r.m AS highestRecommendationScore
    FROM (SELECT userId, count(*) AS n, round(avg(rating), 9) AS a FROM ratings GROUP BY 1) h
    LEFT JOIN (SELECT userId, count(*) AS n, round(avg(score), 9) AS a, max(score) AS m FROM recommended GROUP BY 1) r ON r.userId = h.userId""",
)
_add(
    "bundle_checks", lambda s, d: _rounded(views.bundle_checks(rated(s, d), shared.table(s, _fit(s, d, CONFIG).recommendations, d, "recommendations")), "userCoverage"),
    _with(*_model_sql(CONFIG), "steps AS (SELECT *, lag(score) OVER w AS s, lag(movieId) OVER w AS m FROM recommended WINDOW w AS (PARTITION BY userId ORDER BY rank))")
    + """SELECT (SELECT count(*) FROM recommended r JOIN ratings t ON t.userId = r.userId AND t.movieId = r.movieId) AS watchedViolations,
    (SELECT count(*) FROM (SELECT userId, movieId FROM recommended GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicateViolations,
    (SELECT count(*) FROM steps WHERE score > s OR (score = s AND movieId < m)) AS orderViolations, count(*) FILTER (score NOT BETWEEN 1 AND 5) AS scoreViolations,
    (SELECT count(DISTINCT userId) FROM recommended WHERE userId NOT IN (SELECT userId FROM ratings)) AS unknownUsers,
    round(count(DISTINCT userId) / CAST((SELECT count(DISTINCT userId) FROM ratings) AS DOUBLE), 9) AS userCoverage FROM recommended""",
)
_add(
    "metadata_coverage", lambda s, d: _rounded(stats.metadata_coverage(rated(s, d), metadata(s, d)), "metadataCoverage"),
    _with(METADATA_SQL, "rated AS (SELECT DISTINCT movieId FROM ratings)") + "SELECT count(*) AS ratedMovies, count(m.movieId) AS withMetadata, round(count(m.movieId) / CAST(count(*) AS DOUBLE), 9) AS metadataCoverage FROM rated r LEFT JOIN metadata m ON m.movieId = r.movieId",
)
_add(
    "prefix_subset", lambda s, d: views.prefix_subset(rated(s, d).select("userId", "movieId", "rating"), 2000),
    _with("u AS (SELECT userId, coalesce(sum(c) OVER (ORDER BY userId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT userId, count(*) AS c FROM ratings GROUP BY 1))")
    + "SELECT r.userId, movieId, rating FROM ratings r JOIN u ON u.userId = r.userId WHERE before < 2000",
)
_add("line_count", lambda s, d: stats.lines(_table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))), "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lineCount FROM documents")
_add(
    "dedup_rows", lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(), "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"
)

# ---- benchmark summaries ---------------------------------------------------------------------------------

_MEANS = "predictionCoverage precisionAtK recallAtK hitRateAtK ndcgAtK mrrAtK".split()
_COMPARED = ["meanTotalPipelineSeconds", "populationStddevSeconds", *[f"mean{c[0].upper()}{c[1:]}" for c in _MEANS]]
_add(
    "method_comparison", lambda s, d: _rounded(benchmarks.method_comparison(runs(s, d)), *_COMPARED, digits=6),
    f"""WITH {RUNS_SQL} SELECT profile, ratingsRows, method, count(*) AS experiments, round(avg(totalPipelineSeconds), 6) AS meanTotalPipelineSeconds, min(totalPipelineSeconds) AS minTotalPipelineSeconds,
    max(totalPipelineSeconds) AS maxTotalPipelineSeconds, round(stddev_pop(totalPipelineSeconds), 6) AS populationStddevSeconds, {', '.join(f'round(avg({c}), 6) AS mean{c[0].upper()}{c[1:]}' for c in _MEANS)}
    FROM runs WHERE status = 'completed' GROUP BY 1, 2, 3""",
)
_RATIOS = "runtimeGrowthFactor ratingsThroughput pairGrowthRelativeToRatings similarityGrowthRelativeToPairs recommendationUserCoverage"
_add(
    "growth_factor", lambda s, d: _rounded(benchmarks.size_scaling(runs(s, d)), *_RATIOS.split(), digits=6),
    f"""WITH {RUNS_SQL}, done AS (SELECT * FROM runs WHERE status = 'completed'),
    base AS (SELECT profile, method, totalPipelineSeconds AS b FROM (SELECT *, row_number() OVER (PARTITION BY profile, method ORDER BY ratingsRows, experimentId, repetition) AS k FROM done WHERE totalPipelineSeconds > 0) WHERE k = 1)
    SELECT d.profile, d.method, ratingsRows, experimentId, repetition, totalPipelineSeconds, round(totalPipelineSeconds / nullif(b, 0), 6) AS runtimeGrowthFactor, round(ratingsRows / nullif(totalPipelineSeconds, 0), 6) AS ratingsThroughput,
    round(itemPairRows / nullif(CAST(ratingsRows AS DOUBLE), 0), 6) AS pairGrowthRelativeToRatings, round(similarityRows / nullif(CAST(itemPairRows AS DOUBLE), 0), 6) AS similarityGrowthRelativeToPairs,
    round(recommendationUsers / nullif(CAST(testRows AS DOUBLE), 0), 6) AS recommendationUserCoverage FROM done d LEFT JOIN base ON base.profile = d.profile AND base.method = d.method""",
)
_add(
    "benchmark_summary", lambda s, d: benchmarks.summary(runs(s, d)),
    f"WITH {RUNS_SQL} SELECT count(*) FILTER (status = 'completed') AS successfulCount, count(*) FILTER (status <> 'completed') AS failedCount, min(ratingsRows) FILTER (status = 'completed') AS minRatingsRows, max(ratingsRows) FILTER (status = 'completed') AS maxRatingsRows FROM runs",
)
_SHARES = [n.replace("Seconds", "Share") for n in _STAGES]
_list_sql = "list_filter([" + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {{'s': {n}, 'i': {{sign}}{i}, 'n': '{n}'}} END" for i, n in enumerate(_STAGES)) + "], lambda x: x IS NOT NULL)"
_add(
    "stage_shares", lambda s, d: _rounded(benchmarks.stage_shares(benchmarks.chosen(runs(s, d), method="cosine")), *_SHARES),
    f"WITH {RUNS_SQL} SELECT experimentId, method, repetition, {', '.join(f'round({n} / nullif(totalPipelineSeconds, 0), 9) AS {m}' for n, m in zip(_STAGES, _SHARES))}, list_min({_list_sql.replace('{sign}', '')}).n AS fastestStage, list_max({_list_sql.replace('{sign}', '-')}).n AS slowestStage FROM runs WHERE method = 'cosine'",
)
_add(
    "pipeline_seconds", lambda s, d: _rounded(benchmarks.total_seconds(runs(s, d)).select("experimentId", "totalPipelineSeconds"), "totalPipelineSeconds", digits=6),
    f"WITH {RUNS_SQL} SELECT experimentId, round({' + '.join(f'coalesce({n}, 0)' for n in _STAGES)}, 6) AS totalPipelineSeconds FROM runs",
)
