"""Queries, views, runs, commands, the stream."""

import json

import duckdb
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import schemas
from tessera.operators import benchmarks, pairs, stats, synthetic, views
from tessera.config import ModelConfig
from tessera.plans import artifacts, catalogue, cli, counters, model, queries, runner, text_queries
from tessera.sources import relations, sinks
from tessera.streaming import pair_deltas


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for name in ("customer", "part", "orders", "lineitem", "documents"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", ["ratings_view", "pair_stats", "sim_cosine_topl", "topk_cosine", "topk_cooccurrence", "split_test", "eval_metrics", "user_summary", "prefix_subset", "growth_factor", "stage_shares", "bundle_checks", "split_stats", "cold_start_items", "train_test_overlap", "late_training_users", "prediction_user_without_history", "per_user_metrics", *text_queries.QUERIES])
def test_queries_match_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    wanted = duck.sql(queries.ORACLES[name])
    order = sorted(found.columns)
    assert sorted(wanted.columns) == order
    at = [wanted.columns.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((plain(r) for r in found.select(*order).collect()), key=key) == sorted((plain(tuple(r[i] for i in at)) for r in wanted.fetchall()), key=key)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["userId", "rank", "movieId", "score"]
    assert set(queries.QUERIES) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    plan = catalogue.ratings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    ranked = catalogue.QUERIES["topk_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked and "Cartesian" not in ranked and "Python" not in ranked


def test_views(spark):
    ratings = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (2, 1, 5)], "userId long, movieId long, rating int")
    recommended = spark.createDataFrame([(1, 1, 3, 4.5), (1, 2, 4, 4.5), (3, 1, 1, 9.0)], "userId long, rank int, movieId long, score double")
    movies = spark.createDataFrame([(3, "Three", 1999, "X")], schemas.METADATA)
    assert rows(views.titled(recommended, movies), "movieId", "title", "year", "genres") == [(1, "Movie 1", None, ""), (3, "Three", 1999, "X"), (4, "Movie 4", None, "")]
    assert rows(views.user_summary(ratings, recommended)) == [(1, 2, 2, 3.0, 4.5, 4.5), (2, 1, 0, 5.0, None, None)]
    c = views.bundle_checks(ratings, recommended).first()
    assert (c.watchedViolations, c.orderViolations, c.scoreViolations, c.unknownUsers, c.userCoverage) == (0, 0, 1, 1, 0.5)
    wrong = spark.createDataFrame([(1, 1, 3, 4.0), (1, 2, 4, 4.5), (1, 3, 2, 4.5)], recommended.schema)
    assert rows(views.order_errors(wrong), "movieId") == [(2,), (4,)]
    assert rows(stats.list_items(sinks.recommendation_lines(recommended))) == [(2, 3, 2 * len("1\t3:4.5000000000") + len(",4:4.5000000000") + 2)]
    with pytest.raises(ValueError, match="no history"):
        views.checked_profiles(pairs.histories(ratings), __import__("tessera.operators.topk", fromlist=["x"]).lists(recommended))
    assert rows(views.profiles(pairs.histories(ratings), __import__("tessera.operators.topk", fromlist=["x"]).lists(recommended)).select("userId", F.size("recommendations"))) == [(1, 2), (2, 0)]
    shown = ratings.limit(1).select(views.metric_text(F.lit(0.5), "percent"), views.metric_text(F.lit(None).cast("double"), "number"), views.metric_text(F.lit(3), "count")).first()
    assert tuple(shown) == ("50.000%", "N/A", "3")


def test_coverage_and_official_counts(spark):
    ratings = spark.createDataFrame([(1, 1, 4), (1, 2, 2)], "userId long, movieId long, rating int")
    movies = spark.createDataFrame([(1, "A", None, "")], schemas.METADATA)
    assert rows(stats.metadata_coverage(ratings, movies)) == [(2, 1, 0.5)]
    with pytest.raises(ValueError, match="official"):
        stats.official(ratings)


def test_synthetic(spark):
    made = synthetic.ratings(spark, 30, 40, 10)
    assert made.count() == 300 == made.select("userId", "movieId").distinct().count()
    assert made.select("movieId").distinct().count() == 40
    few = synthetic.ratings(spark, 4, 30, 8)
    assert few.count() == 32 == few.select("userId", "movieId").distinct().count() and few.select("movieId").distinct().count() == 30
    assert rows(made) == rows(synthetic.ratings(spark, 30, 40, 10)) != rows(synthetic.ratings(spark, 30, 40, 10, seed=1))
    assert stats.synthetic(made).first().distinctUsers == 30
    assert made.where("rating NOT BETWEEN 1 AND 5").isEmpty()
    with pytest.raises(ValueError):
        synthetic.ratings(spark, 3, 4, 5)


def test_runner(spark):
    found = list(runner.experiments("smoke", methods=("cosine",)))
    row = runner.run(spark, found[0])
    assert row["status"] == "completed" and row["ratingsRows"] == 250 and list(row) == schemas.BENCH_COLUMNS
    assert all(row[c] > 0 for c in schemas.BENCH_BYTES) and row["minCommonUsers"] == 1
    assert [(e.users, e.items, e.parameters["top_l"]) for e in runner.experiments("extended", methods=("cosine",))] == [(5000, 5000, 50), (10000, 10000, 75), (20000, 20000, 100)]
    bad = runner.Experiment("smoke", "cosine", 5, 5, 9, parameters={})
    failed = runner.run_all(spark, iter([bad, found[0]]), fail_fast=True)
    assert len(failed) == 1 and failed[0]["status"] == "failed" and failed[0]["errorMessage"]
    frame = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert frame.select(F.try_divide("a", "b")).first()[0] is None
    with pytest.raises(ValueError):
        list(runner.experiments("none"))


def test_growth_is_against_the_smallest(spark):
    data = [("e1", "p", "cosine", 1, 100, "completed", 2.0), ("e2", "p", "cosine", 1, 200, "completed", 6.0), ("e3", "p", "cosine", 1, 50, "failed", 1.0)]
    base = spark.createDataFrame(data, "experimentId string, profile string, method string, repetition int, ratingsRows long, status string, totalPipelineSeconds double")
    full = base.withColumns({c: F.lit(10) for c in ("testRows", "itemPairRows", "similarityRows", "recommendationUsers")})
    assert rows(benchmarks.size_scaling(full), "experimentId", "runtimeGrowthFactor", "ratingsThroughput") == [("e1", 1.0, 50.0), ("e2", 3.0, 200 / 6)]
    assert rows(benchmarks.summary(full)) == [(2, 1, 100, 200)]
    assert [r.experimentId for r in benchmarks.ordered(full).collect()] == ["e3", "e1", "e2"]
    assert benchmarks.chosen(full, "p", "All").count() == 3 and benchmarks.chosen(full, "q").count() == 0


def test_counters(spark):
    df, seen = counters.observed_pairs(spark.createDataFrame([(1, 2, 3), (1, 3, 1)], "movieI long, movieJ long, commonUsers long"))
    df.collect()
    assert seen.get == {"finalPairs": 2, "contributions": 4}
    data = [(1, 1, 5), (1, 2, 3), (2, 1, 4), (2, 2, 2), (2, 3, 5), (3, 2, 4), (3, 3, 1), (4, 9, 2)]
    ratings = spark.createDataFrame(data, "userId long, movieId long, rating int")
    fitted = model.fit(ratings, ModelConfig(top_l=1, top_k=1))
    found = counters.pairs(ratings, fitted.pairs).first()
    assert (found.validUserHistories, found.usersWithSingleItem, found.pairsEmitted, found.finalUnorderedPairs, found.commonUserContributions) == (4, 1, 5, 3, 5)
    found = counters.similarity(fitted.pairs, 2, "cosine", 1).first()
    assert (found.pairsFilteredByMinCommonUsers, found.directedRelationsBeforeTopL, found.directedRelationsAfterTopL, found.zeroDenominatorRelationsSkipped, found.sourceItems) == (1, 4, 3, 0, 3)
    predicted, recommended = fitted.predictions(), fitted.recommendations()
    found = counters.scoring(ratings, fitted.relations, predicted).first()
    assert (found.userHistoryRows, found.sourceMoviesJoined, found.sourceMoviesWithoutSimilarities, found.contributionsEmitted, found.predictionRows) == (4, 3, 1, 7, predicted.count())
    found = counters.top_k(ratings, predicted, recommended).first()
    assert found.usersProcessed == 4 and found.usersWithoutPredictions == 1 and found.rawPredictionRows == predicted.count()
    assert found.unseenCandidatesConsidered == found.recommendationsEmitted + found.candidatesDiscardedByTopK == found.rawPredictionRows - found.predictionsFilteredAsWatched
    lines = spark.createDataFrame([(schemas.RATINGS_HEADER,), ("1,1,5,2005-01-01",), ("1,1,5,2005-01-01",)], "value string")
    found = counters.history(lines, ratings.limit(2), ratings.limit(1)).first()
    assert (found.inputRows, found.headerRows, found.validRatingRows, found.exactDuplicatesIgnored, found.usersEmitted) == (3, 1, 2, 1, 1)


def test_artifacts(tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    assert artifacts.export({"x.txt": str(tmp_path / "a.txt")}, str(tmp_path / "out"))["x.txt"]["bytes"] == 3
    with pytest.raises(FileNotFoundError):
        artifacts.export({"y": str(tmp_path / "none")}, str(tmp_path / "out"))
    made = artifacts.own(str(tmp_path / "run"))
    with pytest.raises(FileExistsError):
        artifacts.own(str(made))
    artifacts.own(str(made), replace=True)
    with pytest.raises(PermissionError):
        artifacts.own(str(tmp_path / "out"), replace=True)
    assert artifacts.safe_member("a/b.txt") and not any(map(artifacts.safe_member, ("../x", "/x", "a/../../b", "C:x")))


def test_archives(tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("set/ratings.dat", "1::2::3::4")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out.txt", "x")
    digest = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="digest"):
        artifacts.extract(str(tmp_path / "a.zip"), str(tmp_path / "x"), "0" * 64)
    assert artifacts.extract(str(tmp_path / "a.zip"), str(tmp_path / "x"), digest)["members"] == ["set/ratings.dat"] and (tmp_path / "x/set/ratings.dat").read_text() == "1::2::3::4"
    with pytest.raises(FileExistsError):
        artifacts.extract(str(tmp_path / "a.zip"), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="unsafe"):
        artifacts.extract(str(tmp_path / "b.zip"), str(tmp_path / "y"))
    assert not (tmp_path / "out.txt").exists() and not (tmp_path / "y").exists()


def test_stages_resume(tmp_path):
    ran = []
    stages = model.Stages(str(tmp_path), ["a", "b"])
    for _ in range(2):
        for name in ("a", "b"):
            stages.run(name, lambda n=name: ran.append(n), {"x": 1})
    assert ran == ["a", "b"]
    model.Stages(str(tmp_path), ["a", "b"], force_from="b").run("b", lambda: ran.append("b"), {"x": 1})
    stages.run("a", lambda: ran.append("a"), {"x": 2})
    assert ran == ["a", "b", "b", "a"]
    with pytest.raises(ZeroDivisionError):
        stages.run("a", lambda: 1 / 0, {"x": 3})
    assert json.loads((tmp_path / "a.json").read_text())["status"] == "failed"
    with pytest.raises(ValueError):
        model.Stages(str(tmp_path), ["a"], force_from="z")


def test_commands(spark, tmp_path, capsys):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    users = [(u, m, (u + m) % 5 + 1, f"2005-01-{m + 1:02d}") for u in range(1, 6) for m in range(1, 7) if (u + m) % 3]
    source = put("r.csv", "userId,movieId,rating,date\n" + "".join(f"{u},{m},{r},{d}\n" for u, m, r, d in users))
    to = lambda name: str(tmp_path / name)
    assert cli.main(["--local", "split", "--input", source, "--train", to("train"), "--test", to("test")]) == 0
    assert cli.main(["user-history", "--input", to("train"), "--output", to("h")]) == 0
    assert cli.main(["item-pairs", "--input", to("h"), "--output", to("p")]) == 0
    assert cli.main(["similarity", "--input", to("p"), "--output", to("s"), "--method", "cooccurrence"]) == 0
    assert cli.main(["scoring", "--history", to("h"), "--similarity", to("s"), "--output", to("q")]) == 0
    assert cli.main(["top-k", "--history", to("h"), "--predictions", to("q"), "--output", to("t"), "--top-k", "2"]) == 0
    assert cli.main(["evaluate", "--train", to("train"), "--test", to("test"), "--predictions", to("q"), "--recommendations", to("t"), "--output", to("m.json"), "--top-k", "2"]) == 0
    said = json.loads((tmp_path / "m.json").read_text())
    assert said["test_rows"] == 5 and said["watched_recommendations_found"] == 0
    assert cli.main(["line-count", "--input", source, "--output", to("n")]) == 0
    assert spark.read.text(to("n")).first().value == f"lineCount\t{len(users) + 1}"
    assert cli.main(["item-pairs", "--input", to("h"), "--output", to("p")]) == 1  # it exists
    assert cli.main(["item-pairs", "--input", to("h"), "--output", to("h")]) == 2
    assert cli.main(["top-k"]) == 2 and cli.main(["--help"]) == 0
    assert cli.main(["similarity", "--input", to("p"), "--output", to("s2"), "--top-l", "0"]) == 2


def test_top_k_history_rows(spark, tmp_path):
    """Of one user's history lines identical ones are ignored, different ones fail."""
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    scores = put("q", "101,3\t3.8000000000\n101,1\t5.0000000000\n")
    run = lambda history, name: cli.main(["--local", "top-k", "--history", put(f"h-{name}", history), "--predictions", scores, "--output", str(tmp_path / name)])
    assert run("101\t1:5\n101\t1:5\n", "same") == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "same")).collect()] == ["101\t3:3.8000000000"]
    assert run("101\t1:5\n101\t1:4\n", "other") == 1 and run("101\t1:5\n101\t2:5\n", "third") == 1
    assert run("102\t1:5\n", "none") == 1


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([(10, 4, 3, 2, 0.75, None)], "k int, relevance_threshold int, test_rows int, matched_test_predictions int, prediction_coverage double, rmse double")
    assert json.loads(sinks.metrics_json(m))["rmse"] is None
    with pytest.raises(ValueError):
        sinks.metrics_json(spark.createDataFrame([(float("nan"),)], "x double"))
    users = spark.createDataFrame([(1, None, 0.5)], "userId long, predictedScore double, ndcg double")
    assert tuple(sinks.per_user_csv(users).first()) == (1, None, "0.5000000000")
    sinks.write_csv(users, str(tmp_path / "u"), ["userId"])
    text = next((tmp_path / "u").glob("part-*")).read_text()
    assert text == "userId,predictedScore,ndcg\n1,,0.5\n"


def test_streamed_pairs_add_up(spark, tmp_path):
    ratings = catalogue.ratings(spark, SF).select("userId", "movieId", "rating")
    histories = pairs.histories(ratings)
    for part in (0, 1):
        histories.where(F.col("userId") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(histories.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pair_deltas.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(pair_deltas.merged(spark, str(tmp_path / "out"))) == rows(pairs.pair_statistics(ratings))


def test_large_texts_are_written_in_passes(spark, tmp_path, monkeypatch):
    """Pairs and predictions are compressed, in passes of whole keys with no shuffle files left, and come back the same; texts that a chain alone needed go."""
    from tessera.plans import shared

    monkeypatch.setattr(shared, "_made", {})
    names = "scan_pair_stats scan_similarity scan_predictions scan_recommendations list_items".split()
    whole = {n: rows(queries.QUERIES[n](spark, SF)) for n in names}
    assert shared.folders(spark, text_queries._pairs(spark, SF))[0].endswith("pass-0")
    monkeypatch.setattr(shared, "_made", {})
    monkeypatch.setattr(text_queries, "PASS_ROWS", 30_000)
    last = text_queries._recommended(spark, SF)
    assert not shared.written(spark, SF, "pairs") and not shared.written(spark, SF, "predictions")
    assert {n: rows(queries.QUERIES[n](spark, SF)) for n in names} == whole
    assert text_queries._recommended(spark, SF) == last
    for of, key in ((text_queries._pairs, 0), (text_queries._predicted, 0)):
        passes = shared.folders(spark, of(spark, SF))
        seen = [{r.value.split("\t")[0].split(",")[key] for r in relations.lines(spark, p).collect()} for p in passes]
        assert len(passes) > 3 and sum(map(len, seen)) == len(set.union(*seen))
        assert all(f.endswith(".gz") for p in passes for f in relations.lines(spark, p).inputFiles())
    assert spark.conf.get(shared._CLEANUP, "false") == "false"
