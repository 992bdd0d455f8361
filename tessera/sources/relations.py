"""Scans of the text and CSV relations. All are strict: a malformed row fails the query with the row in the message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera import schemas
from tessera.functions import checks, numbers


#: Names that do not end in ``.log``, as a glob.
NO_LOGS = "{*[^g],*[^o]g,*[^l]og,*[^.]log}"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): every text record, blank ones included. Directories are read as part files; hidden, ``_`` and ``.log`` files are not."""
    return spark.read.option("pathGlobFilter", NO_LOGS).text(path)


def _fields(df: DataFrame, separator: str, n: int, what: str) -> tuple[DataFrame, list[Column], Column]:
    line = F.col("value")
    parts = F.split(line, separator, -1)
    fine = checks.checked(F.size(parts) == n, line, "string", checks.told(f"{what} must have {n} fields", line))
    split = df.select(F.split(fine, separator, -1).alias("f"), line.alias("value"))
    return split, [F.col("f")[i] for i in range(n)], F.col("value")


#: A positive id or count as the sinks write it; it fits 64 bits.
_WHOLE = "[1-9][0-9]{0,17}"


def _split(line: Column, n: int, what: str) -> Column:
    fine = checks.checked(F.size(F.split(line, "[,\t]", -1)) == n, line, "string", checks.told(f"{what} must have {n} fields", line))
    return F.split(fine, "[,\t]", -1)


def _keyed(texts: DataFrame, plain: str, kinds: dict[str, str], strict: Callable[[Column], Column]) -> DataFrame:
    """The columns ``kinds`` and the ``line`` of lines ``a,b<TAB>value,...``: cast where the values match ``plain``, the way the sinks write them, and what ``strict`` makes of the other lines, a struct.

    One match decides over a line, instead of one or two for each field. The rules for other lines stay out of the generated
    code: higher-order functions are interpreted.
    """
    line = F.col("value")
    fields = F.when(line.rlike(rf"^{_WHOLE},{_WHOLE}\t{plain}\z"), F.split(line, ",", -1))
    rows = texts.select(fields.alias("f"), line.alias("line"))
    rows = rows.select("f", F.when(F.col("f").isNull(), F.transform(F.array("line"), strict)[0]).alias("s"), "line")
    f = F.col("f")
    parts = [f[0], F.substring_index(f[1], "\t", 1), F.substring_index(f[1], "\t", -1), *[f[i] for i in range(2, len(kinds) - 1)]]
    return rows.select(*[F.when(f.isNotNull(), part.cast(kind)).otherwise(F.col("s")[name]).alias(name) for part, (name, kind) in zip(parts, kinds.items(), strict=True)], "line")


def ratings(spark: SparkSession, path: str, header: str = "anywhere") -> DataFrame:
    """Normalized ratings, each row checked; the exact header line is skipped ``anywhere``, or ``first``: must be the first line of each file and occurs there alone."""
    rows = lines(spark, path)
    if header == "first":
        return csv_ratings(spark, path)
    rows = rows.where(F.col("value") != schemas.RATINGS_HEADER)
    split, f, line = _fields(rows, ",", 4, "a rating")
    return split.select(
        checks.positive_id(f[0], "userId", line).alias("userId"), checks.positive_id(f[1], "movieId", line).alias("movieId"),
        checks.star_rating(f[2], line).alias("rating"), checks.iso_date(f[3], line).alias("date"),
    )


def _checked_header(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(value): the lines but each file's header, which must be its first line and occur there alone.

    Files stay split: what is gathered is one row per file, its first line by the order in which a task reads it.
    """
    line = F.regexp_replace("value", "^\ufeff", "")
    rows = lines(spark, path).select(line.alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    placed = rows.withColumn("__at", F.struct("__start", F.monotonically_increasing_id()))
    files = placed.groupBy("__file").agg(F.min_by("value", "__at").alias("__first"), F.count_if(F.col("value") == header).alias("__n"))
    fine = checks.checked((F.col("__first") == header) & (F.col("__n") == 1), F.col("__file"), "string", checks.told(f"the first line must be {header}, and no other", F.col("__first")))
    return rows.where(F.col("value") != header).join(files.select(fine.alias("__file")), "__file").select("value")


def csv_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Normalized ratings with the header as the first line; leading zeros of ids pass."""
    split, f, line = _fields(_checked_header(spark, path, schemas.RATINGS_HEADER), ",", 4, "a rating")
    return split.select(
        checks.positive_id(f[0], "userId", line, loose=True).alias("userId"), checks.positive_id(f[1], "movieId", line, loose=True).alias("movieId"),
        checks.star_rating(f[2], line).alias("rating"), checks.iso_date(f[3], line).alias("date"),
    )


def unique_ratings(rows: DataFrame, by: list[str] | None = None, identical: str = "ignore", conflicting: str = "fail") -> DataFrame:
    """One rating per user and movie; identity is the rating with the date, or the columns ``by``."""
    identity = by or [c for c in rows.columns if c not in ("userId", "movieId")]
    return checks.one_per_key(rows, ["userId", "movieId"], identity, "conflicting ratings", identical, conflicting).select(*rows.columns)


def timestamped(spark: SparkSession, path: str) -> DataFrame:
    """D2: ratings with Unix seconds, whose UTC text and date must follow from them; a repeated (user, movie) fails."""
    split, f, line = _fields(_checked_header(spark, path, schemas.RATINGS_TS_HEADER), ",", 6, "a rating")
    seconds = checks.count_text(f[3], "timestamp", line)
    rows = split.select(
        checks.positive_id(f[0], "userId", line, loose=True).alias("userId"), checks.positive_id(f[1], "movieId", line, loose=True).alias("movieId"),
        checks.star_rating(f[2], line).alias("rating"), seconds.alias("timestamp"), f[4].alias("dateTimeUtc"), f[5].alias("date"), line.alias("line"),
    )
    fine = (F.col("dateTimeUtc") == numbers.utc_text(F.col("timestamp"))) & (F.col("date") == F.substring("dateTimeUtc", 1, 10))
    same = rows.withColumn("dateTimeUtc", checks.checked(fine, F.col("dateTimeUtc"), "string", checks.told("dateTimeUtc or date doesn't follow from timestamp", F.col("line"))))
    return unique_ratings(same.drop("line"), ["rating", "timestamp"], identical="fail")


def _entries(text: Column, line: Column) -> Column:
    """The entries a:b,c:d of a list as an array of two-element arrays of texts."""
    entries = F.transform(F.split(text, ",", -1), lambda e: F.split(e, ":", -1))
    fine = F.forall(entries, lambda e: F.size(e) == 2)
    return F.when(fine, entries).otherwise(F.raise_error(checks.told("a list entry must be two parts with a colon", line)).cast("array<array<string>>"))


def _listed(texts: DataFrame, what: str) -> DataFrame:
    """(userId, place, a, b, value, n): a row per entry of the lines ``user<TAB>a:b,...``."""
    split, f, line = _fields(texts, "\t", 2, what)
    rows = split.select(checks.positive_id(f[0], "userId", line).alias("userId"), _entries(f[1], line).alias("entries"), line.alias("value"))
    return rows.select("userId", "value", F.size("entries").alias("n"), F.posexplode("entries").alias("place", "e")).select("userId", "place", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"), "value", "n")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(userId, movieId, rating) of history lines; a movie that is repeated in a line and a line that is repeated fail."""
    return _history(lines(spark, path))


def _history(texts: DataFrame) -> DataFrame:
    # lines are compared as wholes and movies within their line, so no entry is shuffled
    counted = texts.groupBy("value").agg(F.count("*").alias("n"))
    once = counted.select(checks.checked(F.col("n") == 1, F.col("value"), "string", checks.told("a history line is repeated", F.col("value"))).alias("value"))
    split, f, line = _fields(once, "\t", 2, "a history")
    rows = split.select(checks.positive_id(f[0], "userId", line).alias("userId"), _entries(f[1], line).alias("e"), line.alias("value"))
    movies = F.transform("e", lambda e: F.trim(e[0]))
    whole = checks.checked(F.size(F.array_distinct(movies)) == F.size("e"), F.col("userId"), "long", checks.told("a movie is repeated in a history", F.col("value")))
    each = rows.select(whole.alias("userId"), "value", F.explode("e").alias("e"))
    return each.select("userId", checks.positive_id(F.col("e")[0], "movieId", F.col("value")).alias("movieId"), checks.star_rating(F.col("e")[1], F.col("value")).alias("rating"))


def unique_histories(spark: SparkSession, path: str) -> DataFrame:
    """History lines with one line per user: an identical one is ignored, another one fails."""
    split, f, line = _fields(lines(spark, path), "\t", 2, "a history")
    rows = split.select(checks.positive_id(f[0], "userId", line).alias("userId"), f[1].alias("list"))
    return checks.one_per_key(rows, ["userId"], ["list"], "conflicting histories")


def history_by_user(spark: SparkSession, path: str) -> DataFrame:
    """(userId, movieId, rating) of the lines of ``unique_histories``: what ranking removes watched movies by."""
    return _history(unique_histories(spark, path).select(F.concat_ws("\t", F.col("userId").cast("string"), "list").alias("value")))


def pair_stats(spark: SparkSession, path: str) -> DataFrame:
    """D5 lines ``i,j<TAB>n,sumXY,sumX2,sumY2`` with i < j and positive sums."""
    return pair_stats_of(lines(spark, path))


def pair_stats_of(texts: DataFrame) -> DataFrame:
    """``pair_stats`` of lines (value)."""
    names = schemas.PAIR_STATS.names

    def strict(line: Column) -> Column:
        f = _split(line, 6, "pair statistics")
        shaped = line.rlike(r"^[^,\t]*,[^,\t]*\t[^,\t]*,[^,\t]*,[^,\t]*,[^,\t]*$")
        i = checks.checked(shaped, checks.positive_id(f[0], "movieI", line), "long", checks.told("pair statistics are malformed", line))
        return F.struct(i.alias("movieI"), checks.positive_id(f[1], "movieJ", line).alias("movieJ"), *[checks.count_text(f[k], names[k], line).alias(names[k]) for k in range(2, 6)])

    rows = _keyed(texts, ",".join([_WHOLE] * 4), {n: "long" for n in names}, strict)
    fine = checks.checked(F.col("movieI") < F.col("movieJ"), F.col("movieI"), "long", checks.told("a pair must be in order", F.col("line")))
    return rows.withColumn("movieI", fine).drop("line")


def similarity(spark: SparkSession, path: str) -> DataFrame:
    """D6 lines ``source,neighbour<TAB>similarity,commonUsers``, similarity in (0, 1]; ``sim10`` is ready for scoring."""

    def strict(line: Column) -> Column:
        f = _split(line, 4, "a similarity")
        return F.struct(
            checks.positive_id(f[0], "sourceId", line).alias("sourceId"), checks.positive_id(f[1], "neighborId", line).alias("neighborId"),
            checks.unit_text(f[2], "similarity", line, 0.0, 1.0, above=True).alias("similarity"), checks.count_text(f[3], "commonUsers", line).alias("commonUsers"),
        )

    # 1, or below it with a digit that is not zero
    unit = rf"(?:1\.0{{1,15}}|0\.(?=0*[1-9])[0-9]{{1,15}}),{_WHOLE}"
    rows = _keyed(lines(spark, path), unit, {"sourceId": "long", "neighborId": "long", "similarity": "double", "commonUsers": "long"}, strict)
    own = checks.checked(F.col("sourceId") != F.col("neighborId"), F.col("sourceId"), "long", checks.told("a movie can't be its own neighbour", F.col("line")))
    return rows.withColumns({"sourceId": own, "sim10": numbers.ten_decimals(F.col("similarity"))}).drop("line")


def predictions(spark: SparkSession, path: str, low: float | None = 1.0, high: float | None = 5.0, identical: str = "ignore") -> DataFrame:
    """D9 lines ``user,movie<TAB>score``, one per user and movie; bounds of the score are the caller's (None: finite)."""
    return one_prediction(prediction_rows(lines(spark, path), low, high), identical)


def prediction_rows(texts: DataFrame, low: float | None = 1.0, high: float | None = 5.0) -> DataFrame:
    """The rows of prediction lines (value), repeated ones too."""

    def strict(line: Column) -> Column:
        f = _split(line, 3, "a prediction")
        return F.struct(checks.positive_id(f[0], "userId", line).alias("userId"), checks.positive_id(f[1], "movieId", line).alias("movieId"), checks.unit_text(f[2], "score", line, low, high).alias("score"))

    rows = _keyed(texts, r"[0-9]{1,4}\.[0-9]{1,10}", {"userId": "long", "movieId": "long", "score": "double"}, strict)
    within = (F.lit(True) if low is None else F.col("score") >= low) & (F.lit(True) if high is None else F.col("score") <= high)
    return rows.withColumn("score", checks.checked(within, F.col("score"), "double", checks.told("score is out of range", F.col("line")))).drop("line")


def one_prediction(rows: DataFrame, identical: str = "ignore") -> DataFrame:
    return checks.one_per_key(rows, ["userId", "movieId"], ["score"], "conflicting predictions", identical)


def recommendations(spark: SparkSession, path: str, k: int | None = None, repeated: str = "fail") -> DataFrame:
    """D10 lines ``user<TAB>movie:score,...`` in long form: at most k entries, ordered, movies unique, scores in [1, 5]; one line per user."""
    split, f, line = _fields(lines(spark, path), "\t", 2, "recommendations")
    whole = split.select(checks.positive_id(f[0], "userId", line).alias("userId"), f[1].alias("list"))
    whole = checks.one_per_key(whole, ["userId"], ["list"], "repeated recommendations", identical="ignore" if repeated == "ignore" else "fail")
    entries = whole.select("userId", _entries(F.col("list"), F.col("list")).alias("e"), F.col("list"))
    typed = F.transform("e", lambda e: F.struct(e[1].try_cast("double").alias("score"), F.when(e[0].rlike(r"^[1-9][0-9]*$"), e[0]).try_cast("long").alias("movieId")))
    rows = entries.select("userId", typed.alias("r"), "list")
    fine = F.forall("r", lambda x: x["score"].between(1, 5) & x["movieId"].isNotNull()) & (F.size(F.array_distinct(F.transform("r", lambda x: x["movieId"]))) == F.size("r"))
    following = F.arrays_zip(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))).alias("a"), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("b"))
    fine = fine & F.forall(following, lambda p: (p["a"]["score"] > p["b"]["score"]) | ((p["a"]["score"] == p["b"]["score"]) & (p["a"]["movieId"] < p["b"]["movieId"])))
    if k is not None:
        fine = fine & (F.size("r") <= k)
    kept = rows.where(checks.checked(fine, F.lit(True), "boolean", checks.told("recommendations are malformed or out of order", F.col("list"))))
    return kept.select("userId", F.posexplode("r").alias("place", "x")).select("userId", (F.col("place") + 1).alias("rank"), "x.movieId", "x.score")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """D11: CSV with a header; unique ids, titles that are not blank, a year of four digits or none."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    genres = F.col("genres") if "genres" in raw.columns else F.lit("")
    line = F.concat_ws(",", *[F.col(c) for c in raw.columns])
    year = F.trim(F.coalesce("year", F.lit("")))
    rows = raw.select(
        checks.positive_id(F.col("movieId"), "movieId", line, loose=True).alias("movieId"),
        checks.checked(F.trim("title") != "", F.trim("title"), "string", checks.told("title must not be blank", line)).alias("title"),
        checks.checked(year.rlike(r"^(\d{4})?$"), F.lit(True), "boolean", checks.told("year must be blank or four digits", line)).alias("ok"),
        year.try_cast("int").alias("year"), F.coalesce(genres, F.lit("")).alias("genres"),
    )
    return checks.one_per_key(rows.where("ok").drop("ok"), ["movieId"], ["title", "year", "genres"], "repeated metadata", identical="fail")


def evaluation_metrics(spark: SparkSession, path: str) -> DataFrame:
    """D13: one JSON object; shares from 0 to 1, errors not negative, counts not negative."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    shares = [c for c in raw.columns if c.endswith(("_coverage", "_at_k"))]
    fine = F.lit(True)
    for c in shares:
        fine = fine & F.col(c).between(0, 1)
    for c in ("mae", "rmse"):
        if c in raw.columns:
            fine = fine & (F.col(c).isNull() | (F.col(c).cast("double") >= 0))
    for c in ("test_rows", "matched_test_predictions", "missing_test_predictions"):
        if c in raw.columns:
            fine = fine & (F.col(c) >= 0)
    return raw.where(checks.checked(fine, F.lit(True), "boolean", "evaluation metrics are out of range"))


def benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    """D15: the benchmark columns, numbers parsed leniently (blank, non-numeric and infinite are null)."""
    raw = spark.read.option("header", True).csv(path)
    missing = set(schemas.BENCH_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"benchmark results lack {sorted(missing)}")
    whole = {*schemas.BENCH_SIZES, *schemas.BENCH_ROWS, *schemas.BENCH_BYTES}
    text = {*schemas.BENCH_TEXT, *schemas.BENCH_STATUS}
    return raw.select(*[F.col(c) if c in text else (numbers.lenient_long(F.col(c)) if c in whole else numbers.lenient_double(F.col(c))).alias(c) for c in schemas.BENCH_COLUMNS])
