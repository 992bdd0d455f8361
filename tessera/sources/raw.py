"""Scans of the source formats, before they are normalized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.functions import checks, numbers

#: Why a row of a header-block file is rejected.
REJECT_REASONS = ["rating_before_movie_header", "wrong_field_count", "invalid_user_id", "invalid_rating", "invalid_date", "malformed_movie_header", "invalid_movie_id"]
#: Fixed value: the date of ratings whose source has none.
NO_DATE = "1970-01-01"


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", pattern: str = "*") -> DataFrame:
    """(path, pos, line): the lines of each file in order, found recursively. A file is one record, as its lines depend on each other."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.regexp_replace(F.decode("content", encoding), r"\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)).alias("pos", "line"))


def header_blocks(spark: SparkSession, path: str, pattern: str = "mv_*.txt") -> DataFrame:
    """(path, pos, kind, reason, userId, movieId, rating, date): every line of header-block files, classified.

    ``kind`` is blank, header, rating or invalid; a line that ends with a colon is a header or invalid, and an
    invalid one does not change the current movie.
    """
    lines = numbered_lines(spark, path, pattern=pattern).withColumn("line", F.trim("line"))
    header = F.col("line").rlike(r"^[1-9]\d*:$")
    movie = F.when(header, F.substring("line", F.lit(1), F.length("line") - 1).try_cast("long"))
    running = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("movieId", F.last(movie, ignorenulls=True).over(running)).withColumn("f", F.split("line", ",", -1))
    field = lambda i: F.trim(F.get("f", i))
    date = F.when(field(2).rlike(r"^\d{4}-\d{2}-\d{2}$"), field(2)).try_cast("date")
    user = F.when(field(0).rlike(r"^[1-9]\d*$"), field(0)).try_cast("long")
    reason = (
        F.when(F.col("line").endswith(":") & F.col("line").rlike(r"^(0+|-\d+):$"), "invalid_movie_id")
        .when(F.col("line").endswith(":"), "malformed_movie_header")
        .when(F.col("movieId").isNull(), "rating_before_movie_header")
        .when(F.size("f") != 3, "wrong_field_count")
        .when(user.isNull(), "invalid_user_id")
        .when(~field(1).rlike(r"^[1-5]$"), "invalid_rating")
        .when(date.isNull(), "invalid_date")
    )
    kind = F.when(F.col("line") == "", "blank").when(header, "header").when(reason.isNotNull(), "invalid").otherwise("rating")
    own = lambda c: F.when(F.col("kind") == "rating", c)
    return rows.withColumns({"kind": kind, "reason": F.when(kind == "invalid", reason), "__user": user, "__date": date}).select(
        "path", "pos", "kind", "reason", own(F.col("__user")).alias("userId"), own(F.col("movieId")).alias("movieId"), own(field(1).try_cast("int")).alias("rating"), own(F.col("__date")).alias("date")
    )


def header_block_ratings(classified: DataFrame) -> DataFrame:
    """Distinct ratings of ``header_blocks``'s rows; conflicting ones stay."""
    return classified.where("kind = 'rating'").select("userId", "movieId", "rating", "date").distinct()


def header_block_stats(classified: DataFrame) -> DataFrame:
    """One row: files, headers, rows by outcome, duplicates removed, and the rejects of each reason."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    counts = classified.agg(
        F.count_distinct("path").alias("files_processed"), kind("header").alias("movie_headers"), F.count_if(F.col("kind").isin("rating", "invalid")).alias("input_rating_rows"),
        kind("rating").alias("valid_rating_rows"), kind("invalid").alias("invalid_rating_rows"), kind("blank").alias("blank_lines"), *[F.count_if(F.col("reason") == r).alias(r) for r in REJECT_REASONS],
    )
    out = counts.crossJoin(header_block_ratings(classified).agg(F.count("*").alias("output_rows")))
    return out.withColumn("duplicate_rows_removed", F.col("valid_rating_rows") - F.col("output_rows"))


def _colons(spark: SparkSession, path: str, n: int, what: str) -> tuple[DataFrame, list[Column], Column]:
    # lines are independent, so files stay split; the text scan keeps the bytes as they are
    rows = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))
    parts = F.split("line", "::", n if what == "movie" else -1)
    fine = checks.checked(F.size(parts) == n, F.col("line"), "string", checks.told(f"a {what} must have {n} fields", F.col("line")))
    split = rows.select(F.split(fine, "::", n if what == "movie" else -1).alias("f"), "line")
    return split, [F.col("f")[i] for i in range(n)], F.col("line")


def colon_ratings(spark: SparkSession, path: str) -> DataFrame:
    """D2 from ``user::movie::rating::timestamp`` in Latin-1: identical repeats are ignored, conflicts fail."""
    split, f, line = _colons(spark, path, 4, "rating")
    rows = split.select(
        checks.positive_id(f[0], "userId", line, loose=True).alias("userId"), checks.positive_id(f[1], "movieId", line, loose=True).alias("movieId"),
        checks.star_rating(f[2], line).alias("rating"), checks.count_text(f[3], "timestamp", line).alias("timestamp"),
    )
    one = checks.one_per_key(rows, ["userId", "movieId"], ["rating", "timestamp"], "conflicting ratings").select("userId", "movieId", "rating", "timestamp")
    return one.withColumn("dateTimeUtc", numbers.utc_text(F.col("timestamp"))).withColumn("date", F.substring("dateTimeUtc", 1, 10))


def colon_movies(spark: SparkSession, path: str) -> DataFrame:
    """D11 from ``id::Title (YYYY)::genres``; a title without a year keeps its text and has none."""
    split, f, line = _colons(spark, path, 3, "movie")
    titled = r"^(.*)\s+\((\d{4})\)$"
    whole = F.trim(f[1])
    rows = split.select(
        checks.positive_id(f[0], "movieId", line, loose=True).alias("movieId"),
        checks.checked(whole != "", F.when(whole.rlike(titled), F.regexp_extract(whole, titled, 1)).otherwise(whole), "string", checks.told("title must not be blank", line)).alias("title"),
        F.when(whole.rlike(titled), F.regexp_extract(whole, titled, 2)).try_cast("int").alias("year"), F.trim(f[2]).alias("genres"),
    )
    return checks.one_per_key(rows, ["movieId"], ["title", "year", "genres"], "repeated movie", identical="fail")


def colon_users(spark: SparkSession, path: str) -> DataFrame:
    """D12 from ``id::gender::age::occupation::zip``."""
    split, f, line = _colons(spark, path, 5, "user")
    rows = split.select(
        checks.positive_id(f[0], "userId", line, loose=True).alias("userId"), checks.checked(f[1].isin("M", "F"), f[1], "string", checks.told("gender must be M or F", line)).alias("gender"),
        checks.count_text(f[2], "age", line).cast("int").alias("age"), checks.count_text(f[3], "occupation", line, least=0).cast("int").alias("occupation"), F.trim(f[4]).alias("zip"),
    )
    return checks.one_per_key(rows, ["userId"], ["gender", "age", "occupation", "zip"], "repeated user", identical="fail")


def file_set(spark: SparkSession, path: str, files: int = 15) -> list[str]:
    """The names of the rating files, which must be exactly mv_0000001.txt up to the number of files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "mv_*.txt").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = sorted(r.name for r in listed.limit(files + 1).collect())
    wanted = [f"mv_{i:07d}.txt" for i in range(1, files + 1)]
    if found != wanted:
        raise ValueError(f"expected {wanted[0]} to {wanted[-1]}, found {len(found)} files: missing {sorted(set(wanted) - set(found))}, unexpected {sorted(set(found) - set(wanted))}")
    return found


def three_columns(spark: SparkSession, path: str) -> DataFrame:
    """D3 from ``user,movie,rating`` files mv_<movie>.txt; the movie must be the file's. Blank lines are ignored."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "mv_*.txt").text(path)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")
    line, parts = F.col("line"), F.split("line", ",", -1)
    fine = checks.checked(F.size(parts) == 3, line, "string", checks.told("a rating must have 3 fields", line))
    named = F.regexp_extract("path", r"mv_(\d+)\.txt$", 1).try_cast("long")
    split = rows.select(F.split(fine, ",", -1).alias("f"), "line", named.alias("named"))
    typed = split.select(
        checks.positive_id(F.col("f")[0], "userId", line, loose=True).alias("userId"), checks.positive_id(F.col("f")[1], "movieId", line, loose=True).alias("movieId"),
        checks.star_rating(F.col("f")[2], line).alias("rating"), "named", "line",
    )
    same = checks.checked(F.col("movieId") == F.col("named"), F.col("movieId"), "long", checks.told("movieId isn't the file's", line))
    return checks.one_per_key(typed.withColumn("movieId", same).drop("named", "line"), ["userId", "movieId"], ["rating"], "conflicting ratings")


def with_no_date(ratings: DataFrame) -> DataFrame:
    """Undated ratings as D1, after the split."""
    return ratings.select("userId", "movieId", "rating", F.lit(NO_DATE).cast("date").alias("date"))


def sniff(spark: SparkSession, path: str) -> str:
    """``header-block`` or ``three-column``, by the first line that is not blank."""
    first = numbered_lines(spark, path, pattern="mv_*.txt").where(F.trim("line") != "").orderBy("path", "pos").limit(1).collect()
    if not first:
        raise ValueError(f"no lines in {path}")
    text = first[0].line.strip()
    if text.endswith(":") and text[:-1].isdigit():
        return "header-block"
    if len(text.split(",")) == 3:
        return "three-column"
    raise ValueError(f"unknown rating format: {text[:60]!r}")


def movie_titles(spark: SparkSession, path: str) -> DataFrame:
    """D11 (no genres) from ``id,title`` or ``id,year,title``; further commas belong to the title."""
    rows = spark.read.text(path).select(F.col("value").alias("line"))
    line, f = F.col("line"), F.split("line", ",", -1)
    long = F.size(f) >= 3
    year = F.when(long, F.trim(f[1])).otherwise(F.lit(""))
    title = F.trim(F.when(long, F.array_join(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))), ",")).otherwise(F.get(f, F.lit(1))))
    title = F.regexp_replace(title, '^"(.*)"$', "$1")
    fine = (F.size(f) >= 2) & year.rlike(r"^(\d{4})?$") & (title != "")
    typed = rows.where(checks.checked(fine, F.lit(True), "boolean", checks.told("a title must be movieId,title or movieId,year,title", line))).select(
        checks.positive_id(f[0], "movieId", line, loose=True).alias("movieId"), title.alias("title"), year.try_cast("int").alias("year")
    )
    return checks.one_per_key(typed, ["movieId"], ["title", "year"], "repeated movie", identical="fail")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
