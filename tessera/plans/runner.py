"""Benchmark profiles and runs: each run is a row of the benchmark columns, failures included."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera import schemas
from tessera.config import METHODS, ModelConfig
from tessera.operators import pairs as pairing, split as splits, stats, synthetic, topk
from tessera.plans import model
from tessera.sources import sinks

#: The profiles' sizes (users, items, ratings per user) with minimum common users, Top-L and Top-K of each.
PROFILES = {
    "smoke": [(25, 50, 10, 1, 10, 5), (100, 100, 10, 1, 10, 5), (200, 150, 15, 1, 10, 5)],
    "standard": [(500, 500, 20, 1, 25, 5), (1000, 1000, 25, 2, 50, 10), (2000, 2000, 25, 3, 75, 10)],
    "extended": [(5000, 5000, 20, 2, 50, 10), (10000, 10000, 25, 3, 75, 20), (20000, 20000, 25, 5, 100, 20)],
}


@dataclass(frozen=True)
class Experiment:
    profile: str
    method: str
    users: int
    items: int
    ratings_per_user: int
    seed: int = 42
    repetition: int = 1
    parameters: dict = field(default_factory=dict, hash=False)

    @property
    def name(self) -> str:
        return f"{self.profile}-{self.users * self.ratings_per_user}-{self.method}"


def experiments(profile: str, repetitions: int = 1, methods: tuple[str, ...] = METHODS) -> Iterator[Experiment]:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}: {', '.join(PROFILES)}")
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    for users, items, each, *rest in PROFILES[profile]:
        parameters = dict(zip(("min_common_users", "top_l", "top_k"), rest, strict=True))
        for method in methods:
            for r in range(1, repetitions + 1):
                yield Experiment(profile, method, users, items, each, repetition=r, parameters=parameters)


def run(spark: SparkSession, experiment: Experiment) -> dict:
    """A benchmark row. A failing stage is recorded with its message."""
    row = dict.fromkeys(schemas.BENCH_COLUMNS) | {
        "experimentId": experiment.name, "profile": experiment.profile, "datasetType": "synthetic", "method": experiment.method, "seed": experiment.seed, "users": experiment.users,
        "items": experiment.items, "ratingsPerUser": experiment.ratings_per_user, "repetition": experiment.repetition,
    }
    began, stage, held = time.time(), "", []

    def timed(name: str, df: DataFrame) -> tuple[DataFrame, int]:
        nonlocal stage
        stage, t = name, time.time()
        df = df.persist()
        held.append(df)
        n = df.count()
        row[f"{name}Seconds"] = time.time() - t
        return df, n

    def size(name: str, lines: DataFrame) -> None:
        row[name] = lines.agg(stats.text_bytes()).first()[0]

    try:
        config = ModelConfig(method=experiment.method, **experiment.parameters)
        row |= {"minCommonUsers": config.min_common_users, "topL": config.top_l, "topK": config.top_k, "relevanceThreshold": config.relevance_threshold, "reducers": int(spark.conf.get("spark.sql.shuffle.partitions"))}
        ratings, row["ratingsRows"] = timed("datasetGeneration", synthetic.ratings(spark, experiment.users, experiment.items, experiment.ratings_per_user, experiment.seed))
        train, test = splits.leave_one_out(ratings)
        train, row["trainRows"] = timed("split", train)
        row["testRows"] = test.count()
        size("ratingsInputBytes", sinks.csv_lines(ratings))
        size("trainBytes", sinks.csv_lines(train))
        _, row["userHistoryRows"] = timed("userHistory", pairing.histories(train))
        size("userHistoryBytes", sinks.history_lines(train))
        table, row["itemPairRows"] = timed("pairStatistics", pairing.pair_statistics(train))
        size("itemPairBytes", sinks.pair_lines(table))
        fitted = model.fit(train, config, table)
        fitted.relations, row["similarityRows"] = timed("similarity", fitted.relations)
        size("similarityBytes", sinks.similarity_lines(fitted.relations))
        predicted, row["rawPredictionRows"] = timed("scoring", fitted.predictions())
        size("rawPredictionBytes", sinks.prediction_lines(predicted))
        recommended, row["recommendationItems"] = timed("topK", topk.recommendations(predicted, train, config.top_k))
        size("recommendationBytes", sinks.recommendation_lines(recommended))
        row["recommendationUsers"] = recommended.select("userId").distinct().count()
        stage, t = "evaluation", time.time()
        found = fitted.evaluation(test)[0].first()
        row["evaluationSeconds"] = time.time() - t
        for name in schemas.BENCH_METRICS:
            snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
            row[name] = found[snake]
        row["totalPipelineSeconds"] = sum(row[c] for c in schemas.STAGE_SECONDS)
        row["status"] = "completed"
    except Exception as e:  # a failed run is a row
        row |= {"status": "failed", "errorStage": stage, "errorMessage": str(e)[:500]}
    finally:
        for df in held:
            df.unpersist()
    return row | {"totalRunSeconds": time.time() - began}


def run_all(spark: SparkSession, found: Iterator[Experiment], fail_fast: bool = False) -> list[dict]:
    rows = []
    for experiment in found:
        rows.append(run(spark, experiment))
        if fail_fast and rows[-1]["status"] != "completed":
            break
    return rows


def load_profiles(path: str) -> dict:
    """Profiles from JSON, in the form of ``PROFILES``: six positive whole numbers for each size."""
    with open(path) as f:
        found = json.load(f)
    for name, own in found.items():
        if not own or any(len(size) != 6 or any(type(x) is not int or x < 1 for x in size) for size in own):
            raise ValueError(f"profile {name!r} lacks sizes or positive parameters")
    return found
