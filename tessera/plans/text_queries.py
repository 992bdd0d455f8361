"""Queries of the text sources, the sinks and the counters.

Each writes a relation of the driver's tables with a sink into the shared folder, once per application, and scans
it back; the SQL says what must come back from the tables themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera import schemas
from tessera.functions import numbers
from tessera.operators import pairs, scoring, similarity, split, stats, topk, views
from tessera.plans import catalogue, counters, shared
from tessera.plans.catalogue import (
    CONFIG, METADATA_SQL, PAIRS_SQL, PER_USER_SQL, SPLIT_SQL, TRAIN_ALL, Query, _fit, _model_sql, _relations_sql, _rounded, _table, _with, evaluation, metadata, rated,
)
from tessera.plans.shared import MOST_PASSES, SENT_ROWS, share
from tessera.sources import raw, relations, sinks

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _text(spark: SparkSession, sf_dir: str, name: str, make, **how) -> str:
    """The folder of a text relation, written at its first use."""
    return shared.once(spark, lambda path: sinks.write_text(make(), path, **how), sf_dir, name)


def _csv(spark: SparkSession, sf_dir: str, name: str, make, order: list[str]) -> str:
    return shared.once(spark, lambda path: sinks.write_csv(make(), path, order), sf_dir, name)


#: Pairs or contributions that one pass over a large relation holds, about, and those of a task in it.
PASS_ROWS, TASK_ROWS = 25_000_000, 1_000_000


def _n(rows: int, weight: int = 1) -> int:
    """Passes over ``rows`` rows that take as much in a shuffle as ``weight`` pairs each."""
    return max(1, -(-rows * weight // PASS_ROWS))


def _each_pass(spark: SparkSession, sf_dir: str, name: str, n: int, make) -> Iterator[str]:
    """The folders of a large text relation one after another, each written when it is asked for and deleted when the next one is; those of ``_passes`` if a query has had them written, which stay. Arguments as there."""
    if shared.written(spark, sf_dir, name):
        yield from shared.folders(spark, _passes(spark, sf_dir, name, n, make))
        return
    for i in range(n):
        path = f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}/pass-{i}"
        with shared.cleaned(spark):
            sinks.write_text(make(share(n, i)), path, compressed=True, quick=True)
        try:
            yield path
        finally:
            shared.delete(spark, path.rsplit("/", 1)[0])


def _passes(spark: SparkSession, sf_dir: str, name: str, n: int, make) -> str:
    """A glob of the folders of a large text relation, written compressed at its first use.

    ``make(of)`` gives the lines of one of ``n`` passes, whose keys are those where ``of(key)`` holds, and a pass's
    shuffle files go before the next one begins.
    """

    def write(path: str) -> None:
        for i in range(n):
            sinks.write_text(make(share(n, i)), f"{path}/pass-{i}", compressed=True)

    return shared.once(spark, write, sf_dir, name) + "/pass-*"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings as D1."""
    return rated(spark, sf_dir).select("userId", "movieId", "rating", F.to_date("ts").alias("date"))


# ---- ratings as text -------------------------------------------------------------------------------------


def _rating_lines(s: SparkSession, d: str) -> str:
    """Normalized ratings with one header line; five-star ratings are repeated."""

    def make():
        lines = sinks.csv_lines(dated(s, d).withColumn("date", F.col("date").cast("string")))
        header = s.createDataFrame([(schemas.RATINGS_HEADER,)], "value string")
        return header.union(lines).union(lines.where("value LIKE '%,%,5,%'"))

    return _text(s, d, "rating-lines", make)


def _own_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


DATED_SQL = "SELECT userId, movieId, rating, strftime(ts, '%Y-%m-%d') AS date FROM ratings"
_add("scan_ratings", lambda s, d: _own_date(relations.unique_ratings(relations.ratings(s, _rating_lines(s, d)))), _with() + DATED_SQL)


def _ratings_csv(s: SparkSession, d: str) -> str:
    return _csv(s, d, "ratings-csv", lambda: sinks.ratings_csv(dated(s, d)), ["userId", "date", "movieId"])


_add("scan_ratings_csv", lambda s, d: _own_date(relations.unique_ratings(relations.csv_ratings(s, _ratings_csv(s, d)), identical="fail")), _with() + DATED_SQL)


def _timestamped(s: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    rows = rated(s, d).select("userId", "movieId", "rating", seconds.alias("timestamp"))
    return rows.withColumn("dateTimeUtc", numbers.utc_text(F.col("timestamp"))).withColumn("date", F.substring("dateTimeUtc", 1, 10))


_add(
    "scan_timestamped", lambda s, d: relations.timestamped(s, _csv(s, d, "timestamped", lambda: _timestamped(s, d), ["userId", "timestamp", "movieId"])),
    _with() + "SELECT userId, movieId, rating, CAST(epoch(ts) AS BIGINT) AS timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS dateTimeUtc, strftime(ts, '%Y-%m-%d') AS date FROM ratings",
)

# ---- stage relations as text -----------------------------------------------------------------------------


def _history_lines(s: SparkSession, d: str):
    """What ``_passes`` needs: the number of passes over the users, and the history lines of one."""
    ratings = rated(s, d)
    return min(MOST_PASSES, _n(ratings.count(), 4)), lambda of: sinks.history_lines(ratings.where(of("userId")))


def _history(s: SparkSession, d: str) -> str:
    return _passes(s, d, "history", *_history_lines(s, d))


def _histories(s: SparkSession, d: str) -> DataFrame:
    """The scanned history lines, as a table: every pass over the pairs reads it. A user's line and what may repeat it are in one pass."""

    def write(path: str) -> None:
        for i, one in enumerate(_each_pass(s, d, "history", *_history_lines(s, d))):
            shared.put(pairs.histories(relations.history(s, one)), f"{path}/pass-{i}")

    return s.read.parquet(shared.once(s, write, d, "histories") + "/pass-*")


def _pair_lines(s: SparkSession, d: str):
    """What ``_passes`` needs: the number of passes, for PASS_ROWS rows of pairs before their aggregation each, and the lines of one."""
    rows = pairs.pair_estimate(rated(s, d)).first().pairContributions
    tasks = max(1, -(-min(rows, PASS_ROWS) // TASK_ROWS))
    histories = _histories(s, d)
    return _n(rows), lambda of: sinks.pair_lines(pairs.pair_statistics_of(histories, of, tasks).sortWithinPartitions("movieI", "movieJ"))


def _pairs(s: SparkSession, d: str) -> str:
    if shared.written(s, d, "pairs"):
        return _passes(s, d, "pairs", 0, None)
    return _passes(s, d, "pairs", *_pair_lines(s, d))


def _pair_stage(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of the pair texts, each scanned once and deleted before the next is written: one row of what all of them hold, and the pairs with enough common users."""

    def write(path: str) -> None:
        total: dict[str, int] = {}
        for i, one in enumerate(_each_pass(s, d, "pairs", *_pair_lines(s, d))):
            texts, of_lines = counters.observed(relations.lines(s, one), f"lines-{uuid.uuid4().hex}", outputRows=F.count("*"), outputBytes=stats.text_bytes())
            scanned, of_pairs = counters.observed(relations.pair_stats_of(texts), f"pairs-{uuid.uuid4().hex}", **counters.pair_facts(CONFIG.min_common_users))
            shared.put(similarity.supported(scanned, CONFIG.min_common_users), f"{path}/eligible/pass-{i}")
            for k, v in (of_lines.get | of_pairs.get).items():
                total[k] = total.get(k, 0) + v
        s.createDataFrame([tuple(total.values())], ", ".join(f"{k} long" for k in total)).write.parquet(f"{path}/facts")

    path = shared.once(s, write, d, "pair-stage")
    return s.read.parquet(f"{path}/facts"), s.read.parquet(f"{path}/eligible/pass-*")


def _similarity_lines(s: SparkSession, d: str):
    """What ``_passes`` needs: the number of passes over the sources, and the lines of one, of the pairs with enough common users."""
    eligible = _pair_stage(s, d)[1]
    return _n(2 * eligible.count(), 2), lambda of: sinks.similarity_lines(similarity.similarities(eligible, CONFIG, of("sourceId")))


def _similar(s: SparkSession, d: str) -> str:
    if shared.written(s, d, "similarity"):
        return _passes(s, d, "similarity", 0, None)
    return _passes(s, d, "similarity", *_similarity_lines(s, d))


def _near(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The scanned similarity texts as a table in buckets by neighbour, so that a candidate's contributions meet without a shuffle, and the rows that scoring joins of it at most. The texts lie there one pass at a time, and the pairs go, unless another query has had them written."""
    most = rated(s, d).count() * CONFIG.top_l

    def write(path: str) -> None:
        there = shared.written(s, d, "pair-stage")
        passes = (0, None) if shared.written(s, d, "similarity") else _similarity_lines(s, d)
        tasks = max(8, -(-min(most, PASS_ROWS) // TASK_ROWS))
        for one in _each_pass(s, d, "similarity", *passes):
            near = relations.similarity(s, one).select("sourceId", "neighborId", "sim10").repartition(tasks, "neighborId")
            near.write.mode("append").option("compression", "zstd").bucketBy(tasks, "neighborId").option("path", path).saveAsTable(_name(path))
        if not there and shared.written(s, d, "pair-stage"):
            shared.drop(s, d, "pair-stage")

    return s.table(_name(shared.once(s, write, d, "near"))), most


def _name(path: str) -> str:
    return "tessera_" + path.rsplit("-", 1)[1]


def _scored(s: SparkSession, d: str):
    """What ``_passes`` needs: the number of passes over the users, and the lines of one. A pass's histories are sent to all tasks, SENT_ROWS at most."""
    near, rows = _near(s, d)
    n = _prediction_passes(s, d)
    histories = _histories(s, d)
    return n, lambda of: sinks.prediction_lines(scoring.predictions(_sent(s, d, pairs.long_form(histories.where(of("userId"))), n), near).sortWithinPartitions("userId", "movieId"))


def _prediction_passes(s: SparkSession, d: str) -> int:
    return max(_n(_near(s, d)[1]), min(MOST_PASSES, -(-rated(s, d).count() // SENT_ROWS)))


def _sent(s: SparkSession, d: str, rows: DataFrame, n: int) -> DataFrame:
    """The rows of one of ``n`` passes over the ratings, with a hint to broadcast them if these are few enough."""
    return F.broadcast(rows) if rated(s, d).count() <= n * SENT_ROWS else rows


def _predicted(s: SparkSession, d: str) -> str:
    if shared.written(s, d, "predictions"):
        return _passes(s, d, "predictions", 0, None)
    return _passes(s, d, "predictions", *_scored(s, d))


def _scan_predictions(s: SparkSession, d: str) -> DataFrame:
    """The predictions of all passes. Repeated keys are looked for in a pass at a time, and users in two passes; where there are none, no row is shuffled."""
    folders = shared.folders(s, _predicted(s, d))

    def write(path: str) -> None:
        for i, one in enumerate(folders):
            keys = relations.prediction_rows(relations.lines(s, one)).select("userId", "movieId").repartition("userId").groupBy("userId", "movieId").agg(F.count("*").alias("n"))
            keys.groupBy("userId").agg(F.max("n").alias("n")).write.parquet(f"{path}/pass-{i}")

    users = s.read.parquet(shared.once(s, write, d, "prediction-users") + "/pass-*").groupBy("userId").agg(F.sum("n").alias("n"))
    every = relations.prediction_rows(relations.lines(s, _predicted(s, d)))
    return every if users.where("n > 1").isEmpty() else relations.one_prediction(every)


#: The users that a task aggregates side by side at most; more are sorted by user first.
_GROUPS, MOST_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 20_000


def _rank(s: SparkSession, d: str, path: str, wanted: set[str]) -> None:
    """The chain's last stage, over history lines of which every one is there twice; the predictions' passes one by one, as a user's are in one of them: "lines" of the recommendations, and "counts" of each user's predictions."""
    def by_user(path: str) -> None:
        n, make = _history_lines(s, d)
        for i, one in enumerate(_each_pass(s, d, "history-twice", n, lambda of: make(of).select(F.explode(F.array("value", "value")).alias("value")))):
            shared.put(pairs.histories(relations.history_by_user(s, one)), f"{path}/pass-{i}")

    own = s.read.parquet(shared.once(s, by_user, d, "histories-by-user") + "/pass-*")
    n, make = _scored(s, d)
    for i, one in enumerate(_each_pass(s, d, "predictions", n, make)):
        watched = _sent(s, d, pairs.long_form(own.where(share(n, i)("userId"))), n)
        predicted = topk.with_history(relations.one_prediction(relations.prediction_rows(relations.lines(s, one)).repartition("userId")), watched)
        if "lines" not in wanted:
            counters.per_user(predicted, watched).write.parquet(f"{path}/counts/pass-{i}")
            continue
        with shared.set_to(s, _GROUPS, str(MOST_GROUPS)):
            shared.put(topk.best(predicted, watched, CONFIG.top_k), f"{path}/counts/pass-{i}")
        ranked = s.read.parquet(f"{path}/counts/pass-{i}").select("userId", F.inline("best"))
        sinks.write_text(sinks.recommendation_lines(ranked), f"{path}/lines/pass-{i}", compressed=True)
        if "counts" not in wanted:
            shared.delete(s, f"{path}/counts/pass-{i}")


def _recommended(s: SparkSession, d: str) -> str:
    return shared.once(s, lambda path: _rank(s, d, path, {"lines"}), d, "recommendation-lines") + "/lines/pass-*"


def _counted(s: SparkSession, d: str) -> DataFrame:
    """What ``counters.per_user`` says of the predictions."""
    return s.read.parquet(shared.once(s, lambda path: _rank(s, d, path, {"counts"}), d, "prediction-counts") + "/counts/pass-*")


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The recommendations and ``_counted``; written in the same passes if neither is there."""
    if not shared.written(s, d, "recommendation-lines") and not shared.written(s, d, "prediction-counts"):
        shared.once(s, lambda path: _rank(s, d, path, {"lines", "counts"}), d, "recommendation-lines")
        shared.same(s, (d, "recommendation-lines"), (d, "prediction-counts"))
    return relations.recommendations(s, _recommended(s, d)), _counted(s, d)


_add("scan_history", lambda s, d: relations.history(s, _history(s, d)), _with() + "SELECT userId, movieId, rating FROM ratings")
_add("scan_pair_stats", lambda s, d: relations.pair_stats(s, _pairs(s, d)), _with(TRAIN_ALL, PAIRS_SQL) + "SELECT movieI, movieJ, commonUsers, sumXY, sumX2, sumY2 FROM pairs")
_add(
    "scan_similarity", lambda s, d: relations.similarity(s, _similar(s, d)).select("sourceId", "neighborId", "sim10", "commonUsers"),
    _with(TRAIN_ALL, PAIRS_SQL, _relations_sql(CONFIG)) + "SELECT sourceId, neighborId, sim10, commonUsers FROM relations",
)
_add("scan_predictions", _scan_predictions, _with(*_model_sql(CONFIG)[:-1]) + "SELECT userId, movieId, score FROM predicted")
_add("scan_recommendations", lambda s, d: relations.recommendations(s, _recommended(s, d), CONFIG.top_k), _with(*_model_sql(CONFIG)) + "SELECT userId, rank, movieId, score FROM recommended")
_add(
    "user_profiles",
    lambda s, d: views.checked_profiles(pairs.histories(relations.history(s, _history(s, d))), topk.lists(relations.recommendations(s, _recommended(s, d)))).select("userId", F.size("ratings").alias("rated"), F.size("recommendations").alias("recommended")),
    _with(*_model_sql(CONFIG)) + "SELECT h.userId, CAST(h.n AS INTEGER) AS rated, CAST(coalesce(r.n, 0) AS INTEGER) AS recommended FROM (SELECT userId, count(*) AS n FROM ratings GROUP BY 1) h LEFT JOIN (SELECT userId, count(*) AS n FROM recommended GROUP BY 1) r ON r.userId = h.userId",
)
_LINES_SQL = "lines AS (SELECT userId, userId || chr(9) || string_agg(movieId || ':' || printf('%.10f', score), ',' ORDER BY rank) AS value FROM recommended GROUP BY userId)"
_add(
    "list_items", lambda s, d: stats.list_items(relations.lines(s, _recommended(s, d))),
    _with(*_model_sql(CONFIG), _LINES_SQL) + "SELECT count(*) AS rows, (SELECT count(*) FROM recommended) AS items, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes FROM lines",
)
_add(
    "merged_file_digest",
    lambda s, d: raw.file_digests(s, _text(s, d, "history-file", lambda: sinks.history_lines(rated(s, d)).coalesce(1).sortWithinPartitions("userId"), one_file=True) + "/part-*").select("bytes", "sha256"),
    _with() + """SELECT CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, sha256(string_agg(value || chr(10), '' ORDER BY userId)) AS sha256
    FROM (SELECT userId, userId || chr(9) || string_agg(movieId || ':' || rating, ',' ORDER BY movieId) AS value FROM ratings GROUP BY userId)""",
)
_add("line_scan", lambda s, d: stats.lines(relations.lines(s, _text(s, d, "document-lines", lambda: _table(s, d, "documents").select(F.explode(F.split(F.translate("text", "\r", " "), "\n")).alias("value"))))), "SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lineCount FROM documents")

# ---- raw formats -----------------------------------------------------------------------------------------


def _header_blocks(s: SparkSession, d: str) -> str:
    """A block per movie: its header, a blank line, its ratings, the first of them again, a user that is no id, and a header that is none."""

    def make():
        one = F.concat_ws(",", F.col("userId").cast("string"), F.col("rating").cast("string"), F.col("date").cast("string"))
        rows = dated(s, d).groupBy("movieId").agg(F.sort_array(F.collect_list(F.struct("userId", one.alias("line")))).alias("l"))
        lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
        return rows.select(F.concat(F.col("movieId").cast("string"), F.lit(":\n\n"), lines, F.lit("\n"), F.col("l")[0]["line"], F.lit("\nnobody,3,2005-01-01\nx:")).alias("value"))

    return _text(s, d, "header-blocks", make)


_add("scan_header_blocks", lambda s, d: _own_date(raw.header_block_ratings(raw.header_blocks(s, _header_blocks(s, d), "part-*"))), _with() + DATED_SQL)
_ZERO = ", ".join(f"CAST(0 AS BIGINT) AS {r}" for r in raw.REJECT_REASONS if r not in ("invalid_user_id", "malformed_movie_header"))
_add(
    "header_block_stats", lambda s, d: raw.header_block_stats(raw.header_blocks(s, _header_blocks(s, d), "part-*")).drop("files_processed"),
    _with("m AS (SELECT count(DISTINCT movieId) AS m, count(*) AS n FROM ratings)") + f"""SELECT m AS movie_headers, n + 3 * m AS input_rating_rows, n + m AS valid_rating_rows, 2 * m AS invalid_rating_rows, m AS blank_lines,
    m AS invalid_user_id, m AS malformed_movie_header, {_ZERO}, n AS output_rows, m AS duplicate_rows_removed FROM m""",
)


def _colons(s: SparkSession, d: str, name: str, rows: DataFrame, *columns: str) -> str:
    """``::`` lines in Latin-1 (the texts are ASCII here)."""
    return _text(s, d, name, lambda: rows.select(F.concat_ws("::", *[F.col(c).cast("string") for c in columns]).alias("value")))


def _people(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(s, d, "customer").select((key + 1).alias("userId"), F.when(key % 2 == 0, "M").otherwise("F").alias("gender"), (F.col("c_nationkey") + 18).alias("age"), F.col("c_nationkey").alias("occupation"), F.lpad(key.cast("string"), 5, "0").alias("zip"))


_add(
    "scan_colon_ratings", lambda s, d: raw.colon_ratings(s, _colons(s, d, "ratings.dat", _timestamped(s, d), "userId", "movieId", "rating", "timestamp")),
    _with() + "SELECT userId, movieId, rating, CAST(epoch(ts) AS BIGINT) AS timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS dateTimeUtc, strftime(ts, '%Y-%m-%d') AS date FROM ratings",
)
_MOVIES_SQL = f"WITH {METADATA_SQL} SELECT movieId, title, CAST(year AS INTEGER) AS year, genres FROM metadata"
_add(
    "scan_colon_movies",
    lambda s, d: raw.colon_movies(s, _colons(s, d, "movies.dat", metadata(s, d).withColumn("t", F.format_string("%s (%d)", "title", "year")), "movieId", "t", "genres")), _MOVIES_SQL,
)
_add(
    "scan_colon_users", lambda s, d: raw.colon_users(s, _colons(s, d, "users.dat", _people(s, d), "userId", "gender", "age", "occupation", "zip")),
    "SELECT c_custkey + 1 AS userId, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, CAST(c_nationkey + 18 AS INTEGER) AS age, CAST(c_nationkey AS INTEGER) AS occupation, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip FROM customer",
)


def _three_columns(s: SparkSession, d: str) -> str:
    """The fifteen files of a 3-column set, a customer's rating in one of them."""

    def write(path: str) -> None:
        key = F.col("c_custkey")
        movie, rating = F.pmod(key, F.lit(15)) + 1, F.pmod(key, F.lit(5)) + 1
        rows = _table(s, d, "customer").select(movie.alias("m"), F.concat_ws(",", (key + 1).cast("string"), movie.cast("string"), rating.cast("string")).alias("value"))
        rows.repartition("m").write.partitionBy("m").text(path)
        hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
        store = hadoop.Path(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        for i in range(1, 16):
            part = store.globStatus(hadoop.Path(f"{path}/m={i}/part-*"))[0].getPath()
            store.rename(part, hadoop.Path(f"{path}/mv_{i:07d}.txt"))
            store.delete(hadoop.Path(f"{path}/m={i}"), True)

    path = shared.once(s, write, d, "three-columns")
    raw.file_set(s, path)
    return path


_add(
    "scan_three_columns", lambda s, d: _own_date(raw.with_no_date(raw.three_columns(s, _three_columns(s, d)))),
    "SELECT c_custkey + 1 AS userId, c_custkey % 15 + 1 AS movieId, CAST(c_custkey % 5 + 1 AS INTEGER) AS rating, '1970-01-01' AS date FROM customer",
)
_add("format_sniff", lambda s, d: s.createDataFrame([(raw.sniff(s, _three_columns(s, d)),)], "format string"), "SELECT 'three-column' AS format")
_add(
    "scan_titles",
    lambda s, d: raw.movie_titles(s, _text(s, d, "titles", lambda: metadata(s, d).select(F.concat_ws(",", F.col("movieId").cast("string"), F.col("year").cast("string"), F.concat("title", F.lit(", again"))).alias("value")))),
    f"WITH {METADATA_SQL} SELECT movieId, title || ', again' AS title, CAST(year AS INTEGER) AS year FROM metadata",
)
_add("scan_metadata_csv", lambda s, d: relations.metadata(s, _csv(s, d, "metadata", lambda: metadata(s, d), ["movieId"])), _MOVIES_SQL)

# ---- results as text -------------------------------------------------------------------------------------


def _users(s: SparkSession, d: str) -> DataFrame:
    return shared.table(s, lambda: evaluation(s, d)[1], d, "per-user")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return shared.table(s, lambda: evaluation(s, d)[0], d, "metrics")


_SHARES = "prediction_coverage mae rmse precision_at_k recall_at_k ndcg_at_k mrr_at_k".split()
_mean = lambda c, name: f"round(coalesce(avg({c}) FILTER (isRelevant), 0), 9) AS {name}"
_METRICS_SQL = f"""SELECT count(*) AS test_rows, count(predictedScore) AS matched_test_predictions, round(count(predictedScore) / CAST(count(*) AS DOUBLE), 9) AS prediction_coverage, round(avg(absoluteError), 9) AS mae,
    round(sqrt(avg(squaredError)), 9) AS rmse, {_mean('hit / CAST(10 AS DOUBLE)', 'precision_at_k')}, {_mean('CAST(hit AS DOUBLE)', 'recall_at_k')}, {_mean('ndcg', 'ndcg_at_k')}, {_mean('mrr', 'mrr_at_k')} FROM users"""


def _json(s: SparkSession, d: str) -> str:
    def make():
        return s.createDataFrame([(sinks.metrics_json(_metrics(s, d)).strip(),)], "value string")

    return _text(s, d, "metrics.json", make)


_add(
    "scan_metrics_json", lambda s, d: _rounded(relations.evaluation_metrics(s, _json(s, d)).select("test_rows", "matched_test_predictions", *_SHARES), *_SHARES),
    _with(*_model_sql(CONFIG, SPLIT_SQL), PER_USER_SQL) + _METRICS_SQL,
)
_COLUMNS, _TEXTS = "userId testMovieId actualRating predictedScore recommendationRank hit recommendationCount", "absoluteError ndcg mrr"


def _users_csv(s: SparkSession, d: str) -> DataFrame:
    path = _csv(s, d, "per-user-csv", lambda: sinks.per_user_csv(_users(s, d)), ["userId"])
    rows = s.read.option("header", True).csv(path)
    kinds = {"predictedScore": "double", "userId": "long", "testMovieId": "long", "recommendationCount": "long"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "int")).alias(c) for c in _COLUMNS.split()], *[F.col(c).cast("double") for c in _TEXTS.split()])


_add("per_user_csv", _users_csv, _with(*_model_sql(CONFIG, SPLIT_SQL), PER_USER_SQL) + f"SELECT {', '.join(_COLUMNS.split())}, {', '.join(f'round({c}, 10) AS {c}' for c in _TEXTS.split())} FROM users")
_add(
    "report_ranking_table", lambda s, d: sinks.report_table(sinks.metrics_csv(_rounded(_metrics(s, d), *_SHARES, "hit_rate_at_k"), "cosine"), sinks.METHOD_TABLES["ranking_metrics"]),
    _with(*_model_sql(CONFIG, SPLIT_SQL), PER_USER_SQL)
    + f"SELECT 'cosine' AS method, printf('%.10f', precision_at_k) AS precisionAtK, printf('%.10f', recall_at_k) AS recallAtK, printf('%.10f', recall_at_k) AS hitRateAtK, printf('%.10f', ndcg_at_k) AS ndcgAtK, printf('%.10f', mrr_at_k) AS mrrAtK FROM ({_METRICS_SQL})",
)
_FACT = lambda pairs: " UNION ALL ".join(f"SELECT '{name}' AS field, CAST({sql} AS VARCHAR) AS value, 'stats' AS source" for name, sql in pairs)
_add(
    "report_dataset_table", lambda s, d: sinks.fact_table(stats.dataset(rated(s, d)), sinks.DATASET_FIELDS, "stats"),
    _with() + _FACT([("ratingsRows", "(SELECT count(*) FROM ratings)"), ("users", "(SELECT count(DISTINCT userId) FROM ratings)"), ("ratedMovies", "(SELECT count(DISTINCT movieId) FROM ratings)")]),
)
_add(
    "report_split_table", lambda s, d: sinks.fact_table(split.statistics(*split.leave_one_out(rated(s, d), "ts")), sinks.SPLIT_FIELDS, "stats"),
    _with(SPLIT_SQL) + _FACT([("trainRows", "(SELECT count(*) FROM train)"), ("testRows", "(SELECT count(*) FROM test)"), ("trainTestOverlapRows", "(SELECT count(*) FROM train t JOIN test e ON t.userId = e.userId AND t.movieId = e.movieId)")]),
)


def _stage_rows(s: SparkSession, d: str) -> DataFrame:
    """The stages' outputs: rows and bytes of their texts."""
    of = lambda path: relations.lines(s, path).agg(F.count("*").alias("outputRows"), stats.text_bytes().alias("outputBytes"))
    out = None
    for stage, row in (("userHistory", of(_history(s, d))), ("pairStatistics", _pair_stage(s, d)[0].select("outputRows", "outputBytes")), ("similarity", of(_similar(s, d)))):
        row = row.select(F.lit(stage).alias("stage"), F.lit("completed").alias("status"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_add(
    "report_stage_table", lambda s, d: sinks.report_table(_stage_rows(s, d), sinks.STAGE_TABLE),
    _with(
        TRAIN_ALL, PAIRS_SQL, _relations_sql(CONFIG),
        """stages AS (
            SELECT 'userHistory' AS stage, value FROM (SELECT userId || chr(9) || string_agg(movieId || ':' || rating, ',' ORDER BY movieId) AS value FROM ratings GROUP BY userId)
            UNION ALL SELECT 'pairStatistics', movieI || ',' || movieJ || chr(9) || commonUsers || ',' || sumXY || ',' || sumX2 || ',' || sumY2 FROM pairs
            UNION ALL SELECT 'similarity', sourceId || ',' || neighborId || chr(9) || '0.0000000000,' || commonUsers FROM relations
        )""",
    ) + "SELECT stage, 'completed' AS status, '' AS elapsedSeconds, CAST(count(*) AS VARCHAR) AS outputRows, CAST(CAST(sum(strlen(value) + 1) AS BIGINT) AS VARCHAR) AS outputBytes FROM stages GROUP BY stage",
)


def _results(s: SparkSession, d: str) -> str:
    """Benchmark results as CSV with all columns; those that the runs lack are blank."""

    def make():
        runs = catalogue.runs(s, d)
        return runs.select(*[F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in schemas.BENCH_COLUMNS])

    return _csv(s, d, "benchmark-results", make, ["experimentId"])


_add(
    "scan_benchmark_results", lambda s, d: relations.benchmark_results(s, _results(s, d)).select("experimentId", "method", "status", "ratingsRows", "totalPipelineSeconds", "seed", "ndcgAtK"),
    f"WITH {catalogue.RUNS_SQL} SELECT experimentId, method, status, ratingsRows, totalPipelineSeconds, CAST(NULL AS BIGINT) AS seed, ndcgAtK FROM runs",
)
_add(
    "user_download", lambda s, d: sinks.download_csv(views.titled(_fit(s, d, CONFIG).recommendations(), metadata(s, d)), 1),
    _with(*_model_sql(CONFIG), METADATA_SQL) + "SELECT r.rank, r.movieId, title, year, genres, printf('%.10f', r.score) AS predictedScore FROM recommended r JOIN metadata m ON m.movieId = r.movieId WHERE r.userId = 1",
)

# ---- counters and run statistics -------------------------------------------------------------------------


def _history_counters(s: SparkSession, d: str) -> DataFrame:
    path = _rating_lines(s, d)
    parsed = relations.ratings(s, path)
    return counters.history(relations.lines(s, path), parsed, relations.unique_ratings(parsed))


_add(
    "counters_history", _history_counters,
    _with() + "SELECT count(*) + count(*) FILTER (rating = 5) + 1 AS inputRows, CAST(1 AS BIGINT) AS headerRows, count(*) + count(*) FILTER (rating = 5) AS validRatingRows, count(*) AS outputRatings, count(DISTINCT userId) AS usersEmitted, count(*) FILTER (rating = 5) AS exactDuplicatesIgnored FROM ratings",
)
_USERS = "u AS (SELECT count(*) AS c FROM ratings GROUP BY userId)"
_add(
    "counters_pairs", lambda s, d: counters.pairs(rated(s, d), None, _pair_stage(s, d)[0]),
    _with(TRAIN_ALL, PAIRS_SQL, _USERS) + "SELECT count(*) AS validUserHistories, count(*) FILTER (c = 1) AS usersWithSingleItem, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS pairsEmitted, (SELECT count(*) FROM pairs) AS finalUnorderedPairs, (SELECT CAST(sum(commonUsers) AS BIGINT) FROM pairs) AS commonUserContributions FROM u",
)


def _similarity_counters(s: SparkSession, d: str) -> DataFrame:
    facts, eligible = _pair_stage(s, d)
    return counters.similarity(eligible, CONFIG.min_common_users, "cosine", CONFIG.top_l, facts, relations.similarity(s, _similar(s, d)))


_add(
    "counters_similarity", _similarity_counters,
    _with(TRAIN_ALL, PAIRS_SQL, _relations_sql(CONFIG)) + f"""SELECT count(*) AS validPairRows, count(*) FILTER (commonUsers < {CONFIG.min_common_users}) AS pairsFilteredByMinCommonUsers, (SELECT count(*) FROM scored) AS directedRelationsBeforeTopL,
    (SELECT count(DISTINCT sourceId) FROM scored) AS sourceItems, (SELECT count(*) FROM relations) AS directedRelationsAfterTopL, CAST(0 AS BIGINT) AS zeroDenominatorRelationsSkipped, (SELECT count(*) FROM scored) AS directedRelationsCreated FROM pairs""",
)
_add(
    "counters_scoring", lambda s, d: counters.scoring(rated(s, d), relations.similarity(s, _similar(s, d)), None, _counted(s, d)),
    _with(*_model_sql(CONFIG)[:-1], "m AS (SELECT movieId, count(*) AS r FROM ratings GROUP BY 1)", "n AS (SELECT sourceId, count(*) AS n FROM relations GROUP BY 1)")
    + """SELECT (SELECT count(DISTINCT userId) FROM ratings) AS userHistoryRows, (SELECT count(*) FROM ratings) AS userRatingJoinRecords, (SELECT count(*) FROM relations) AS validSimilarityRows, count(n) AS sourceMoviesJoined,
    count(*) FILTER (n IS NULL) AS sourceMoviesWithoutSimilarities, CAST(coalesce(sum(n * r), 0) AS BIGINT) AS contributionsEmitted, (SELECT count(*) FROM predicted) AS predictionRows FROM m LEFT JOIN n ON n.sourceId = m.movieId""",
)


def _top_k_counters(s: SparkSession, d: str) -> DataFrame:
    recommended, counted = _both(s, d)
    return counters.top_k(rated(s, d), None, recommended, counted)


_add(
    "counters_top_k", _top_k_counters,
    _with(*_model_sql(CONFIG), """p AS (SELECT p.userId, count(*) AS predictions, count(t.movieId) AS watched FROM predicted p LEFT JOIN ratings t ON t.userId = p.userId AND t.movieId = p.movieId GROUP BY 1),
    x AS (SELECT h.userId, p.predictions, p.watched FROM (SELECT DISTINCT userId FROM ratings) h LEFT JOIN p ON p.userId = h.userId), e AS (SELECT count(*) AS n, count(DISTINCT userId) AS u FROM recommended)""")
    + """SELECT count(*) AS usersProcessed, count(*) FILTER (predictions IS NULL) AS usersWithoutPredictions, CAST(sum(predictions) AS BIGINT) AS rawPredictionRows, CAST(sum(watched) AS BIGINT) AS predictionsFilteredAsWatched,
    CAST(sum(predictions - watched) AS BIGINT) AS unseenCandidatesConsidered, count(*) FILTER (predictions = watched) AS usersWithNoUnseenCandidates, any_value(e.n) AS recommendationsEmitted, any_value(e.u) AS usersEmitted,
    CAST(sum(predictions - watched) AS BIGINT) - any_value(e.n) AS candidatesDiscardedByTopK FROM x CROSS JOIN e""",
)


def _run_statistics(s: SparkSession, d: str) -> DataFrame:
    facts, eligible = _pair_stage(s, d)
    return stats.run(None, rated(s, d), eligible, similarity.cosine(eligible), relations.similarity(s, _similar(s, d)), relations.recommendations(s, _recommended(s, d)), facts.select("validPairRows"))


_add(
    "run_statistics", _run_statistics,
    _with(*_model_sql(CONFIG)) + """SELECT count(*) AS acceptedRatings, count(DISTINCT userId) AS users, count(DISTINCT movieId) AS items, (SELECT count(*) FROM pairs) AS unorderedItemPairs, (SELECT count(*) FROM kept) AS eligibleUnorderedItemPairs,
    (SELECT count(*) FROM scored) AS directedEntriesBeforeTopL, (SELECT count(*) FROM relations) AS directedEntriesAfterTopL, (SELECT count(DISTINCT userId) FROM recommended) AS usersWithRecommendations, (SELECT count(*) FROM recommended) AS recommendationRows FROM ratings""",
)
_add(
    "external_statistics", lambda s, d: stats.synthetic(relations.csv_ratings(s, _ratings_csv(s, d))).select("ratingRows", "distinctUsers", "distinctRatedMovies", F.col("minimumTime").cast("string").alias("minimumTime"), F.col("maximumTime").cast("string").alias("maximumTime")),
    _with() + "SELECT count(*) AS ratingRows, count(DISTINCT userId) AS distinctUsers, count(DISTINCT movieId) AS distinctRatedMovies, strftime(min(ts), '%Y-%m-%d') AS minimumTime, strftime(max(ts), '%Y-%m-%d') AS maximumTime FROM ratings",
)
