"""Synthetic ratings from a hash, at any size: each user rates a popular core and a shifted window of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed value: the first day of generated ratings.
START = "2020-01-01"


def ratings(spark: SparkSession, users: int, items: int, per_user: int, seed: int = 42, start: str = START) -> DataFrame:
    """D1 rows. The set is a function of its arguments alone; nothing is generated on the driver.

    Every user rates ``per_user`` different items: about a third of them the popular ones (two at least from
    four on), the others a window that moves with the user and the seed, so neighbours overlap. Items that no
    window reaches take the place of a popular one with one user each (never with the first user, so that all
    popular items stay); so every item occurs, or it is an error.
    """
    if min(users, items, per_user) < 1 or per_user > items:
        raise ValueError("users, items and per_user must be positive, and per_user at most items")
    core = min(per_user, max(2 if per_user >= 4 else 1, per_user // 3))
    rest, width = items - core, per_user - core
    base = spark.range(1, users + 1).withColumnRenamed("id", "userId").select("userId", F.explode(F.sequence(F.lit(0), F.lit(per_user - 1))).alias("slot"))
    shift = F.pmod((F.col("userId") - 1) * max(1, width) + F.lit(seed), F.lit(max(1, rest)))
    window = F.lit(core + 1) + F.pmod(shift + F.col("slot") - core, F.lit(max(1, rest)))
    # the windows tile the ring of the others, so what they leave out is the stretch after the last one
    missing = max(0, rest - users * width)
    if missing > (users - 1) * core:
        raise ValueError("users * per_user is too small for every item to occur")
    number = F.col("slot") * (users - 1) + (F.col("userId") - 2)
    repaired = (F.col("slot") < core) & (F.col("userId") >= 2) & (number < missing)
    spare = F.lit(core + 1) + F.pmod(F.lit(seed + users * width) + number, F.lit(max(1, rest)))
    movie = F.when(repaired, spare).when(F.col("slot") < core, F.col("slot") + 1).otherwise(window).cast("long")
    chosen = base.select("userId", movie.alias("movieId"))
    rating = (F.pmod(F.xxhash64("userId", "movieId", F.lit(seed)), F.lit(5)) + 1).cast("int")
    day = ((F.col("userId") - 1) * per_user + F.pmod(F.xxhash64("movieId", "userId", F.lit(seed)), F.lit(per_user))).cast("int")
    return chosen.select("userId", "movieId", rating.alias("rating"), F.date_add(F.lit(start).cast("date"), day).alias("date"))
