"""Commands: a stage each, from text relations to text relations. Exit 0: done, 1: failed, 2: wrong usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tessera.config import METHODS, ModelConfig
from tessera.operators import evaluate as evaluating, pairs, scoring, similarity, split, stats, topk
from tessera.sources import relations, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    out.add_argument("--local", action="store_true", help="run in this process")
    out.add_argument("--reducers", type=int, default=None, help="shuffle partitions")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **options: int) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for path in paths:
            own.add_argument(f"--{path}", required=True)
        for option, default in options.items():
            own.add_argument(f"--{option.replace('_', '-')}", type=int, default=default)
        return own

    command("user-history", "input", "output")
    command("item-pairs", "input", "output")
    command("similarity", "input", "output", min_common_users=1, top_l=50).add_argument("--method", choices=METHODS, default="cosine")
    command("scoring", "history", "similarity", "output")
    command("top-k", "history", "predictions", "output", top_k=10)
    command("split", "input", "train", "test")
    command("evaluate", "train", "test", "predictions", "recommendations", "output", top_k=10, relevance_threshold=4)
    command("line-count", "input", "output")
    return out


def work(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "user-history":
        sinks.write_text(sinks.history_lines(relations.unique_ratings(relations.ratings(spark, a.input))), a.output)
    elif a.command == "item-pairs":
        sinks.write_text(sinks.pair_lines(pairs.pair_statistics(relations.history(spark, a.input))), a.output)
    elif a.command == "similarity":
        config = ModelConfig(method=a.method, min_common_users=a.min_common_users, top_l=a.top_l)
        sinks.write_text(sinks.similarity_lines(similarity.similarities(relations.pair_stats(spark, a.input), config)), a.output)
    elif a.command == "scoring":
        sinks.write_text(sinks.prediction_lines(scoring.predictions(relations.history(spark, a.history), relations.similarity(spark, a.similarity))), a.output)
    elif a.command == "top-k":
        found = topk.recommendations(relations.predictions(spark, a.predictions), relations.history_by_user(spark, a.history), a.top_k, check=True)
        sinks.write_text(sinks.recommendation_lines(found), a.output)
    elif a.command == "split":
        train, test = split.checked_split(relations.unique_ratings(relations.csv_ratings(spark, a.input)))
        for rows, path in ((train, a.train), (test, a.test)):
            sinks.write_csv(sinks.ratings_csv(rows), path, ["userId", "date", "movieId"])
    elif a.command == "evaluate":
        train, test = (relations.unique_ratings(relations.csv_ratings(spark, p)) for p in (a.train, a.test))
        recommended = relations.recommendations(spark, a.recommendations, a.top_k)
        users = evaluating.per_user(test, relations.predictions(spark, a.predictions, None, None), recommended, a.top_k, a.relevance_threshold)
        found = evaluating.metrics(users, a.top_k, a.relevance_threshold, evaluating.watched_violations(recommended, train), split.overlap(train, test))
        with open(a.output, "x") as f:
            f.write(sinks.metrics_json(found))
    else:
        n = stats.lines(relations.lines(spark, a.input)).selectExpr("format_string('lineCount\\t%d', lineCount) AS value")
        sinks.write_text(n, a.output)


def distinct_paths(a: argparse.Namespace) -> None:
    names = [k for k in ("input", "history", "similarity", "predictions", "recommendations", "train", "test", "output") if getattr(a, k, None)]
    paths = [os.path.abspath(getattr(a, k)) for k in names]
    if len(set(paths)) < len(paths):
        raise ValueError("inputs and outputs must be different paths")


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
        distinct_paths(a)
        for name in ("top_l", "top_k", "min_common_users", "reducers"):
            if getattr(a, name, None) is not None and getattr(a, name) < 1:
                raise ValueError(f"{name} must be at least 1")
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master("local[*]") if a.local else builder).getOrCreate()
    if a.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.reducers))
    try:
        work(spark, a)
    except Exception as e:  # the exit code tells
        print(str(e)[:2000], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
