"""The stages against hand-made golden rows."""

import pytest
from conftest import rows

from tessera.config import ModelConfig
from tessera.operators import evaluate, pairs, scoring, similarity, split, topk
from tessera.plans import model

RATINGS = [(101, 3, 5), (101, 1, 4), (102, 2, 5), (103, 4, 5), (102, 1, 3), (104, 5, 3), (103, 2, 4)]
PAIRS = [
    (1, 2, 3, 28, 38, 42), (1, 3, 2, 30, 20, 50), (1, 4, 1, 8, 4, 16), (1, 5, 2, 18, 18, 18), (1, 10, 2, 12, 18, 8), (2, 3, 1, 20, 16, 25), (2, 4, 2, 30, 25, 36), (2, 5, 2, 18, 18, 18),
    (2, 10, 2, 24, 32, 18), (3, 4, 2, 30, 25, 36), (3, 5, 1, 10, 25, 4), (3, 10, 2, 20, 20, 20), (4, 5, 3, 45, 75, 27), (4, 10, 2, 28, 49, 16), (5, 10, 2, 18, 18, 18),
]
HISTORY = [(101, 1, 5), (101, 2, 3), (102, 2, 4), (102, 3, 5), (103, 1, 4), (104, 4, 5)]
SIMILAR = [(1, 2, 0.8, 3), (1, 3, 0.4, 2), (2, 1, 0.8, 3), (2, 3, 0.6, 3), (2, 4, 0.5, 2), (3, 1, 0.4, 2), (3, 2, 0.6, 3), (3, 4, 0.7, 2), (4, 2, 0.5, 2), (4, 3, 0.7, 2)]
SCORES = [
    (101, 1, 3.0), (101, 2, 5.0), (101, 3, 3.8), (101, 4, 3.0), (102, 1, 4.3333333333), (102, 2, 5.0), (102, 3, 4.0), (102, 4, 4.5833333333), (103, 2, 4.0), (103, 3, 4.0), (104, 2, 5.0), (104, 3, 5.0),
]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_history_and_pairs(spark):
    ratings = frame(spark, [(101, 1, 4), (101, 3, 5), (102, 1, 3), (102, 2, 5), (103, 2, 4), (103, 4, 5), (104, 5, 3), (105, 1, 2), (105, 2, 4), (105, 3, 5), (106, 1, 5), (106, 2, 1)], "userId long, movieId long, rating int")
    assert rows(pairs.pair_statistics(ratings)) == [(1, 2, 3, 28, 38, 42), (1, 3, 2, 30, 20, 50), (2, 3, 1, 20, 16, 25), (2, 4, 1, 20, 16, 25)]
    assert rows(pairs.long_form(pairs.histories(ratings))) == rows(ratings)
    assert rows(pairs.pair_estimate(ratings)) == [(6, 1, 7)]


@pytest.mark.parametrize("method", ["cosine", "cooccurrence"])
def test_similarity(spark, method):
    table = frame(spark, PAIRS, "movieI long, movieJ long, commonUsers long, sumXY long, sumX2 long, sumY2 long")
    found = rows(similarity.similarities(table, ModelConfig(method=method, top_l=3)), "sourceId", "neighborId", "sim10")
    near = {s: [n for a, n, _ in found if a == s] for s in (1, 2, 3, 4, 5, 10)}
    if method == "cosine":
        assert near == {1: [4, 5, 10], 2: [3, 4, 5], 3: [2, 4, 5], 4: [1, 2, 3], 5: [1, 2, 3], 10: [1, 2, 3]}
        assert {x for _, _, x in found} == {10**10}
    else:
        assert near == {1: [2, 3, 5], 2: [1, 4, 5], 3: [1, 4, 10], 4: [2, 3, 5], 5: [1, 2, 4], 10: [1, 2, 3]}
        assert (1, 2, 3 * 10**9) in found and (3, 1, 25 * 10**8) in found and (10, 3, 2 * 10**9) in found
        sums = similarity.cooccurrence(table).groupBy("sourceId").sum("similarity").collect()
        assert all(abs(r[1] - 1) < 1e-12 for r in sums)


def test_min_support_comes_first(spark):
    table = frame(spark, PAIRS, "movieI long, movieJ long, commonUsers long, sumXY long, sumX2 long, sumY2 long")
    found = similarity.similarities(table, ModelConfig(method="cooccurrence", min_common_users=2, top_l=10))
    assert found.where("commonUsers < 2").isEmpty()
    assert all(abs(r[1] - 1) < 1e-12 for r in found.groupBy("sourceId").sum("similarity").collect())


def test_zero_norm_is_left_out(spark):
    table = frame(spark, [(1, 2, 1, 0, 0, 4)], "movieI long, movieJ long, commonUsers long, sumXY long, sumX2 long, sumY2 long")
    assert rows(similarity.cosine(table)) == []


def scored(spark):
    ratings = frame(spark, HISTORY, "userId long, movieId long, rating int")
    relations = frame(spark, [(s, n, x, c, round(x * 10**10)) for s, n, x, c in SIMILAR], "sourceId long, neighborId long, similarity double, commonUsers long, sim10 long")
    return ratings, scoring.predictions(ratings, relations)


def test_scores_and_top_k(spark):
    ratings, predicted = scored(spark)
    assert rows(predicted) == SCORES
    more = ratings.union(frame(spark, [(105, 1, 5)], ratings.schema))
    predicted = predicted.union(frame(spark, [(105, 1, 5.0)], predicted.schema))
    assert rows(topk.recommendations(predicted, more, 2, check=True)) == [
        (101, 1, 3, 3.8), (101, 2, 4, 3.0), (102, 1, 4, 4.5833333333), (102, 2, 1, 4.3333333333), (103, 1, 2, 4.0), (103, 2, 3, 4.0), (104, 1, 2, 5.0), (104, 2, 3, 5.0),
    ]
    with pytest.raises(ValueError, match="no history"):
        topk.recommendations(predicted, ratings, 2, check=True)


def test_a_similarity_that_rounds_to_zero_fails(spark):
    relations = frame(spark, [(1, 2, 1e-12, 1, 0)], "sourceId long, neighborId long, similarity double, commonUsers long, sim10 long")
    ratings = frame(spark, [(1, 1, 5)], "userId long, movieId long, rating int")
    with pytest.raises(Exception, match="similarity must lie in"):
        scoring.predictions(ratings, relations).collect()
    assert rows(scoring.published(relations, drop_zero=True)) == []


def test_split(spark):
    data = [(201, 1, 4, "2005-01-01"), (201, 2, 5, "2005-01-03"), (201, 3, 3, "2005-01-03"), (202, 4, 5, "2005-01-04"), (202, 5, 4, "2005-01-02"), (203, 1, 5, "2005-01-01"), (204, 6, 4, "2005-01-02"), (204, 7, 3, "2005-01-01")]
    ratings = frame(spark, data, "userId long, movieId long, rating int, date string").selectExpr("userId", "movieId", "rating", "CAST(date AS date) AS date")
    train, test = split.checked_split(ratings)
    assert rows(test, "userId", "movieId") == [(201, 3), (202, 4), (204, 6)]
    assert train.count() == 5
    facts = split.statistics(train, test).first()
    assert (facts.inputRatings, facts.testRows, facts.coldStartTestItems, facts.usersWithoutTest, facts.trainTestOverlapRows) == (8, 3, 3, 1, 0)
    assert rows(split.leave_one_out(ratings, "item")[1], "userId", "movieId") == [(201, 3), (202, 5), (204, 7)]
    with pytest.raises(ValueError, match="earlier"):
        split.must_be_empty(split.late_training(test, train.where("movieId = 1"), "date"), "earlier")


def test_evaluation(spark):
    train = frame(spark, [(101, 1, 4), (101, 2, 5), (102, 3, 5), (102, 4, 3), (103, 1, 4), (103, 2, 3), (104, 1, 5), (104, 3, 4)], "userId long, movieId long, rating int")
    test = frame(spark, [(101, 3, 5), (102, 1, 4), (103, 4, 3), (104, 2, 5)], "userId long, movieId long, rating int")
    predicted = frame(spark, [(101, 3, 4.5), (102, 1, 3.5), (104, 2, 4.0)], "userId long, movieId long, score double")
    recommended = frame(spark, [(101, 1, 3, 4.5), (101, 2, 4, 4.0), (102, 1, 2, 4.0), (102, 2, 1, 3.5), (104, 1, 5, 4.2), (104, 2, 6, 4.1)], "userId long, rank int, movieId long, score double")
    users = evaluate.per_user(test, predicted, recommended, 2, 4)
    m = evaluate.metrics(users, 2, 4, evaluate.watched_violations(recommended, train), split.overlap(train, test)).first()
    assert (m.matched_test_predictions, m.missing_test_predictions, m.ranking_eligible_users, m.ranking_hits, m.users_with_recommendations) == (3, 1, 3, 2, 3)
    assert [round(x, 4) for x in (m.prediction_coverage, m.mae, m.rmse, m.precision_at_k, m.recall_at_k, m.hit_rate_at_k, m.ndcg_at_k, m.mrr_at_k)] == [0.75, 0.6667, 0.7071, 0.3333, 0.6667, 0.6667, 0.5436, 0.5]
    none = evaluate.metrics(users.where("false"), 2, 4).first()
    assert (none.test_rows, none.prediction_coverage, none.mae, none.ndcg_at_k) == (0, 0.0, None, 0.0)


def test_the_model_does_not_depend_on_partitioning(spark):
    data = [(u, m, (u * 7 + m * 3) % 5 + 1) for u in range(1, 40) for m in range(1, 30) if (u * 7 + m * m + u * m) % 5 < 2]
    ratings = frame(spark, data, "userId long, movieId long, rating int")
    config = ModelConfig(top_l=7, top_k=5, method="cooccurrence")
    first = rows(model.fit(ratings, config).recommendations())
    assert first == rows(model.fit(ratings.repartition(7, "movieId"), config).recommendations())
    assert max(r[1] for r in first) <= 5


def test_full_precision_agrees_without_ties(spark):
    ratings = frame(spark, [(1, 1, 5), (1, 2, 3), (2, 1, 4), (2, 2, 2), (2, 3, 5), (3, 2, 4), (3, 3, 1)], "userId long, movieId long, rating int")
    a = rows(model.fit(ratings, ModelConfig()).predictions())
    b = rows(model.fit(ratings, ModelConfig(precision="full")).predictions())
    assert [(u, m) for u, m, _ in a] == [(u, m) for u, m, _ in b]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("wrong", [{"method": "x"}, {"top_l": 0}, {"top_k": 0}, {"min_common_users": 0}, {"relevance_threshold": 6}, {"precision": "x"}])
def test_config_is_checked(wrong):
    with pytest.raises(ValueError):
        ModelConfig(**wrong)
