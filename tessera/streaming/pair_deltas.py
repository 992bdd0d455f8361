"""Pair statistics kept up to date from a stream of new users' histories.

Pair statistics are sums, so a batch of complete new users adds to them. An extension: results equal the
batch operator's over all users seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import pairs

SUMS = ("commonUsers", "sumXY", "sumX2", "sumY2")


def merged(spark: SparkSession, table: str) -> DataFrame:
    """The sums over all batches in the folder ``table``."""
    return spark.read.parquet(table).groupBy("movieI", "movieJ").agg(*[F.sum(c).alias(c) for c in SUMS])


def start(users: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch's pair sums to ``table``, a folder per batch so that a repeated batch replaces itself.

    ``users`` is a stream of (userId, ratings array<struct<movieId, rating>>), each user once.
    """

    def add(batch: DataFrame, number: int) -> None:
        pairs.pair_statistics(pairs.long_form(batch)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = users.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
