"""Item similarity with Top-L pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.config import ModelConfig
from tessera.functions.numbers import ten_decimals


def supported(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with enough common users; it stands before the co-occurrence denominator on purpose."""
    return pairs.where(F.col("commonUsers") >= least)


def directed(pairs: DataFrame, *values: str) -> DataFrame:
    """Both directions of each pair, in one pass."""
    ways = F.array(F.struct(F.col("movieI").alias("sourceId"), F.col("movieJ").alias("neighborId")), F.struct(F.col("movieJ").alias("sourceId"), F.col("movieI").alias("neighborId")))
    return pairs.select(F.inline(ways), *values).where("sourceId <> neighborId")


def cosine(pairs: DataFrame) -> DataFrame:
    """sumXY / sqrt(sumX2 sumY2) over common users; pairs with a zero denominator are left out."""
    norm = F.sqrt(F.col("sumX2").cast("double") * F.col("sumY2").cast("double"))
    scored = pairs.withColumn("norm", norm).where("norm <> 0").withColumn("similarity", F.col("sumXY") / F.col("norm"))
    return directed(scored, "similarity", "commonUsers")


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """Common users over the source's sum of them; rows of a source add up to one before pruning."""
    both = directed(pairs, "commonUsers")
    totals = both.groupBy("sourceId").agg(F.sum("commonUsers").alias("total"))
    return both.join(totals, "sourceId").select("sourceId", "neighborId", (F.col("commonUsers") / F.col("total")).alias("similarity"), "commonUsers")


def best_per_relation(relations: DataFrame) -> DataFrame:
    """The best similarity of each (source, neighbour); nothing changes where they are unique."""
    best = F.max(F.struct("similarity", "commonUsers")).alias("b")
    return relations.groupBy("sourceId", "neighborId").agg(best).select("sourceId", "neighborId", "b.similarity", "b.commonUsers")


def top_l(relations: DataFrame, most: int) -> DataFrame:
    """The most similar neighbours of each source, by unrounded similarity, then neighbour id."""
    order = Window.partitionBy("sourceId").orderBy(F.desc("similarity"), "neighborId")
    return relations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def similarities(pairs: DataFrame, config: ModelConfig, wanted: Column | None = None) -> DataFrame:
    """Directed relations after pruning, of the sources where ``wanted`` holds; ``published`` precision adds ``sim10``, ten decimals as a whole number."""
    method = {"cosine": cosine, "cooccurrence": cooccurrence}[config.method]
    scored = method(supported(pairs, config.min_common_users))
    found = top_l(scored if wanted is None else scored.where(wanted), config.top_l)
    return found.withColumn("sim10", ten_decimals(F.col("similarity"))) if config.precision == "published" else found
