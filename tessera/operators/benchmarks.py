"""Summaries of benchmark results: a row per run, all columns text or numbers, blanks null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera import schemas
from tessera.functions.numbers import safe_divide


def completed(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "completed")


def chosen(results: DataFrame, profile: str = "All", method: str = "All") -> DataFrame:
    """Rows of a profile and a method; ``All`` takes every one."""
    for column, value in (("profile", profile), ("method", method)):
        if value != "All":
            results = results.where(F.col(column) == value)
    return results


def total_seconds(results: DataFrame) -> DataFrame:
    """``totalPipelineSeconds`` as the sum of the stages, null counting as zero; data generation is no stage."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in schemas.STAGE_SECONDS), F.lit(0.0))
    return results.withColumn("totalPipelineSeconds", total)


def size_scaling(results: DataFrame) -> DataFrame:
    """Growth of completed runs: against the smallest dataset of the same profile and method, and ratios between stages."""
    group = Window.partitionBy("profile", "method")
    usable = (F.col("totalPipelineSeconds") > 0) & F.col("ratingsRows").isNotNull()
    key = F.when(usable, F.struct("ratingsRows", "experimentId", "repetition"))
    base = F.min_by("totalPipelineSeconds", key).over(group)
    ratio = lambda a, b: safe_divide(F.col(a), F.col(b))
    return completed(results).select(
        "profile", "method", "ratingsRows", "experimentId", "repetition", "totalPipelineSeconds", safe_divide(F.col("totalPipelineSeconds"), base).alias("runtimeGrowthFactor"),
        ratio("ratingsRows", "totalPipelineSeconds").alias("ratingsThroughput"), ratio("itemPairRows", "ratingsRows").alias("pairGrowthRelativeToRatings"),
        ratio("similarityRows", "itemPairRows").alias("similarityGrowthRelativeToPairs"), ratio("recommendationUsers", "testRows").alias("recommendationUserCoverage"),
    )


def method_comparison(results: DataFrame) -> DataFrame:
    """Completed runs by profile, size and method: runtimes, and means of the metrics that are there."""
    t = "totalPipelineSeconds"
    means = [F.avg(c).alias(f"mean{c[0].upper()}{c[1:]}") for c in ("predictionCoverage", "precisionAtK", "recallAtK", "hitRateAtK", "ndcgAtK", "mrrAtK")]
    return completed(results).groupBy("profile", "ratingsRows", "method").agg(
        F.count("*").alias("experiments"), F.avg(t).alias("meanTotalPipelineSeconds"), F.min(t).alias("minTotalPipelineSeconds"), F.max(t).alias("maxTotalPipelineSeconds"), F.stddev_pop(t).alias("populationStddevSeconds"), *means
    )


def stage_shares(results: DataFrame) -> DataFrame:
    """Each stage's share of its run, and the names of the fastest and slowest stage (the first of equals)."""
    stages = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("name"))) for i, c in enumerate(schemas.STAGE_SECONDS)])
    there = F.filter(stages, lambda x: x.isNotNull())
    # the maximum with the lowest place: compare places downwards
    back = F.transform(there, lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("i"), x["name"].alias("name")))
    shares = [safe_divide(F.col(c), F.col("totalPipelineSeconds")).alias(c.replace("Seconds", "Share")) for c in schemas.STAGE_SECONDS]
    return results.select("experimentId", "method", "repetition", *shares, F.array_min(there)["name"].alias("fastestStage"), F.array_max(back)["name"].alias("slowestStage"))


def summary(results: DataFrame) -> DataFrame:
    """One row: completed and other runs, and the range of completed sizes."""
    done = F.col("status") == "completed"
    return results.agg(
        F.count_if(done).alias("successfulCount"), F.count_if(~done).alias("failedCount"), F.min(F.when(done, F.col("ratingsRows"))).alias("minRatingsRows"), F.max(F.when(done, F.col("ratingsRows"))).alias("maxRatingsRows")
    )


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("profile", "method", F.coalesce("ratingsRows", F.lit(-1)), "experimentId", F.coalesce("repetition", F.lit(0)))
