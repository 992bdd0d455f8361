"""The recommender from ratings to metrics, as one lazy plan, and its runs with manifests."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from tessera.config import ModelConfig
from tessera.operators import evaluate, pairs, scoring, similarity, topk


@dataclass
class Model:
    """What training gives. It is built from training ratings only; no test rating can reach it."""

    config: ModelConfig
    train: DataFrame
    pairs: DataFrame
    relations: DataFrame

    def predictions(self) -> DataFrame:
        return scoring.predictions(self.train, self.relations, self.config.precision)

    def recommendations(self) -> DataFrame:
        """The Top-K. Watched candidates never affect others, so they are removed before ranking."""
        return topk.recommendations(self.predictions(), self.train, self.config.top_k)

    def evaluation(self, test: DataFrame, predicted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(metrics, per-user diagnostics) against held-out ratings; a watched recommendation or an overlap is counted there. ``predicted``: the predictions, if they are at hand."""
        predicted = self.predictions() if predicted is None else predicted
        recommended = topk.recommendations(predicted, self.train, self.config.top_k)
        k, threshold = self.config.top_k, self.config.relevance_threshold
        users = evaluate.per_user(test, predicted, recommended, k, threshold)
        watched = evaluate.watched_violations(recommended, self.train)
        both = self.train.select("userId", "movieId").intersect(test.select("userId", "movieId"))
        return evaluate.metrics(users, k, threshold, watched, both), users


def fit(train: DataFrame, config: ModelConfig, pair_table: DataFrame | None = None) -> Model:
    """A model of training ratings (userId, movieId, rating). ``pair_table`` shares pair statistics between methods."""
    found = pairs.pair_statistics(train) if pair_table is None else pair_table
    return Model(config, train, found, similarity.similarities(found, config))


def compare(metrics: dict[str, DataFrame], *facts: DataFrame) -> DataFrame:
    """A row per method: its metrics, with one-row facts about data and split joined on."""
    out = None
    for method, row in metrics.items():
        named = row.withColumn("method", F.lit(method))
        out = named if out is None else out.unionByName(named)
    for fact in facts:
        out = out.crossJoin(fact)
    return out


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


class Stages:
    """Named stages with manifests on the driver: one is skipped if it completed with the same parameters and inputs and its outputs are there."""

    def __init__(self, folder: str, order: list[str], force_from: str | None = None) -> None:
        if force_from is not None and force_from not in order:
            raise ValueError(f"unknown stage {force_from!r}")
        self.folder, self.order, self.force_from = Path(folder), order, force_from
        self.folder.mkdir(parents=True, exist_ok=True)

    def manifest(self, stage: str) -> Path:
        return self.folder / f"{stage}.json"

    def done(self, stage: str, parameters: dict, inputs: dict[str, str], outputs: list[str]) -> bool:
        if self.force_from is not None and self.order.index(stage) >= self.order.index(self.force_from):
            return False
        try:
            said = json.loads(self.manifest(stage).read_text())
        except (OSError, ValueError):
            return False
        return said["status"] == "completed" and said["parameters"] == parameters and said["inputs"] == inputs and all(Path(o).exists() for o in outputs)

    def run(self, stage: str, work, parameters: dict | None = None, inputs: dict[str, str] | None = None, outputs: list[str] | None = None) -> bool:
        """Runs ``work`` unless it is done; whether it ran. A failure is recorded and raised."""
        if stage not in self.order:
            raise ValueError(f"unknown stage {stage!r}")
        parameters, inputs, outputs = parameters or {}, inputs or {}, outputs or []
        if self.done(stage, parameters, inputs, outputs):
            return False
        began = time.time()
        said = {"stage": stage, "parameters": parameters, "inputs": inputs, "outputs": outputs}
        try:
            work()
        except Exception as e:
            self.manifest(stage).write_text(json.dumps(said | {"status": "failed", "error": str(e)[:2000], "seconds": time.time() - began}, indent=2, sort_keys=True))
            raise
        self.manifest(stage).write_text(json.dumps(said | {"status": "completed", "seconds": time.time() - began}, indent=2, sort_keys=True))
        return True


def run_manifest(config: ModelConfig, **facts) -> str:
    return json.dumps({"parameters": asdict(config), **facts}, indent=2, sort_keys=True)
