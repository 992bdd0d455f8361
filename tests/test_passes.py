"""Texts that are larger than what may lie on a disk at once: written, scanned and deleted pass by pass."""

import pytest

from conftest import SF, rows
from tessera.operators import pairs, topk
from tessera.plans import catalogue, queries, shared, text_queries
from tessera.sources import relations, sinks

CHAIN = "counters_top_k counters_scoring list_items scan_recommendations scan_similarity counters_pairs report_stage_table counters_similarity run_statistics".split()


@pytest.fixture
def small(spark, monkeypatch):
    """Passes of few rows in an application that has written nothing, and the large texts there at each write."""
    monkeypatch.setattr(shared, "_made", {})
    monkeypatch.setattr(text_queries, "PASS_ROWS", 30_000)
    there, seen, write, delete = set(), [], sinks.write_text, shared.delete
    large = lambda path: any(f"/{n}-" in path for n in ("pairs", "predictions"))

    def writing(lines, path, *a, **how):
        if large(path):
            there.add(path.rsplit("/pass-", 1)[0] + path.rsplit("/pass-", 1)[1])
            seen.append(len(there))
        write(lines, path, *a, **how)

    def deleting(session, path):
        there.difference_update([x for x in there if x.startswith(path)])
        delete(session, path)

    monkeypatch.setattr(sinks, "write_text", writing)
    monkeypatch.setattr(shared, "delete", deleting)
    return seen


@pytest.fixture(scope="module")
def whole(spark):
    """What the queries give in one pass."""
    return {n: rows(queries.QUERIES[n](spark, SF)) for n in CHAIN}


@pytest.mark.parametrize("name", CHAIN)
def test_one_pass_lies_on_disk_at_a_time(spark, whole, small, name):
    assert rows(queries.QUERIES[name](spark, SF)) == whole[name]
    assert len(small) > 3 and max(small) == 1


@pytest.mark.parametrize("tasks", [1, 3])
def test_pair_statistics_of_histories(spark, tasks):
    data = [(1, 2, 5), (1, 2**62, 3), (1, 9, 1), (2, 9, 4), (2, 2, 2), (3, 7, 5), (4, 7, 1), (4, 9, 2)]
    ratings = spark.createDataFrame(data, "userId long, movieId long, rating int")
    want = rows(pairs.pair_statistics(ratings))
    assert rows(pairs.pair_statistics_of(pairs.histories(ratings), tasks=tasks)) == want and len(want) == 4
    assert rows(pairs.pair_statistics_of(pairs.histories(ratings), lambda i: i == 2, tasks)) == [r for r in want if r[0] == 2]


def test_predictions_meet_without_a_shuffle(spark, small):
    """A pass's contributions are not shuffled: the relations lie in buckets by candidate."""
    from tessera.operators import scoring

    near, _ = text_queries._near(spark, SF)
    ratings = pairs.long_form(text_queries._histories(spark, SF))
    made = scoring.predictions(text_queries._sent(spark, SF, ratings, 1), near)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    assert rows(made) == rows(scoring.predictions(text_queries.rated(spark, SF), relations.similarity(spark, text_queries._similar(spark, SF))))


def test_a_prediction_without_history_fails(spark):
    predicted = spark.createDataFrame([(1, 2, 3.0), (5, 2, 3.0)], "userId long, movieId long, score double")
    ratings = spark.createDataFrame([(1, 9, 3), (1, 8, 2)], "userId long, movieId long, rating int")
    assert rows(topk.with_history(predicted.where("userId = 1"), ratings)) == [(1, 2, 3.0)]
    with pytest.raises(Exception, match="has no history: 5"):
        topk.with_history(predicted, ratings).collect()


@pytest.mark.parametrize(("texts", "want"), [
    ((["1,2\t3.5", "1,3\t2.0"], ["2,2\t3.5"]), [(1, 2, 3.5), (1, 3, 2.0), (2, 2, 3.5)]),
    ((["1,2\t3.5", "1,2\t3.50"], ["2,2\t3.5"]), [(1, 2, 3.5), (2, 2, 3.5)]),
    ((["1,2\t3.5"], ["1,2\t3.5", "1,3\t1.0"]), [(1, 2, 3.5), (1, 3, 1.0)]),
    ((["1,2\t3.5"], ["1,2\t3.6"]), "conflicting predictions for 1,2"),
    ((["1,2\t3.5", "1,2\t3.6"], ["2,2\t3.6"]), "conflicting predictions for 1,2"),
    ((["1,2\t3.5"], ["2,2\t6.0"]), "score is out of range"),
])
def test_predictions_are_checked_a_pass_at_a_time(spark, tmp_path, monkeypatch, texts, want):
    monkeypatch.setattr(shared, "_made", {})
    for i, lines in enumerate(texts):
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / f"pass-{i}"))
    monkeypatch.setattr(text_queries, "_predicted", lambda s, d: f"file://{tmp_path}/pass-*")
    if isinstance(want, str):
        with pytest.raises(Exception, match=want):
            queries.QUERIES["scan_predictions"](spark, SF).collect()
    else:
        found = queries.QUERIES["scan_predictions"](spark, SF)
        assert rows(found) == want
        # repeated keys in a text cost a shuffle of all rows, other texts none
        assert ("hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == (sum(map(len, texts)) > len(want))


@pytest.fixture
def written(spark, monkeypatch):
    """Each write of a text in an application that has written nothing: its name, and whether another text of that name is there; whether it is compressed."""
    monkeypatch.setattr(shared, "_made", {})
    monkeypatch.setattr(text_queries, "PASS_ROWS", 12_000)
    there, seen, write, delete = set(), [], sinks.write_text, shared.delete

    def writing(lines, path, *a, **how):
        name = path.split("/")[-2 if "/lines/" not in path else -3].rsplit("-", 1)[0]
        seen.append((name, any(f"/{name}-" in x for x in there), how.get("compressed", False)))
        there.add(path)
        write(lines, path, *a, **how)

    def deleting(session, path):
        there.difference_update([x for x in there if x.startswith(path)])
        delete(session, path)

    monkeypatch.setattr(sinks, "write_text", writing)
    monkeypatch.setattr(shared, "delete", deleting)
    return seen


def _alone(seen, name):
    """Whether ``name`` was written in several passes, with no other of its passes there."""
    beside = [x for n, x, _ in seen if n == name]
    return len(beside) > 1 and not any(beside)


def test_ratings_and_histories_are_made_a_pass_at_a_time(spark, whole, written, monkeypatch):
    monkeypatch.setattr(shared, "SENT_ROWS", 400)
    assert rows(queries.QUERIES["scan_similarity"](spark, SF)) == whole["scan_similarity"]
    assert len(shared.folders(spark, shared.once(spark, None, SF, "ratings") + "/pass-*")) > 2
    assert rows(catalogue.rated(spark, SF)) == rows(catalogue.ratings(spark, SF))
    assert _alone(written, "history") and len([n for n, _, _ in written if n == "similarity"]) > 1


def test_a_repeated_line_in_a_pass_fails(spark, written, monkeypatch):
    lines = sinks.history_lines
    monkeypatch.setattr(sinks, "history_lines", lambda r: lines(r).union(lines(r).where("userId = 7")))
    with pytest.raises(Exception, match="a history line is repeated"):
        text_queries._histories(spark, SF)


def test_ranking_keeps_no_text_that_it_has_scanned(spark, whole, written):
    assert rows(queries.QUERIES["list_items"](spark, SF)) == whole["list_items"]
    assert _alone(written, "history-twice") and _alone(written, "similarity")
    assert not any(shared.written(spark, SF, n) for n in ("history", "history-twice", "similarity", "pair-stage"))


def test_recommendations_lie_compressed(spark, whole, written, monkeypatch):
    monkeypatch.setattr(text_queries, "PASS_ROWS", 100_000)
    assert rows(queries.QUERIES["scan_recommendations"](spark, SF)) == whole["scan_recommendations"]
    assert {c for n, _, c in written if n == "recommendation-lines"} == {True}
