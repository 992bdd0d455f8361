"""Texts that are written without formatters, and scanned with one match a line where they are written the way the sinks do."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tessera.functions import numbers
from tessera.operators import topk
from tessera.sources import relations, sinks

PAIRS = (relations.pair_stats, ["1,2\t3,28,38,42", f"{2**62},{2**63 - 1}\t3,28,38,42", " 1 , 9\t07,1,1,1"], [(1, 2, 3, 28, 38, 42), (1, 9, 7, 1, 1, 1), (2**62, 2**63 - 1, 3, 28, 38, 42)])


def _scans_as_before(spark, tmp_path, scan, lines, want):
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "t"))
    found = scan(spark, f"file://{tmp_path}/t")
    assert rows(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "transform(array(" in plan and "RLIKE" in plan.replace("(", " ( ")
    # the rules for other lines are in the function of that array alone
    assert "trim(" not in re.sub(r"lambdafunction\(.*", "", plan)


def test_plain_pair_lines_are_matched_once(spark, tmp_path):
    _scans_as_before(spark, tmp_path, *PAIRS)


@pytest.mark.parametrize("line", ["1,2\t3,28,38", "1,2,3\t28,38,42", "1\t2,3\t28,38,42", "1,2\t3,28,38,0", "0,2\t3,28,38,42", "2,1\t3,28,38,42", "1,99999999999999999999\t3,28,38,42", "1,2\t3,28,38,42 x", ""])
def test_other_pair_lines_meet_the_rules(spark, tmp_path, line):
    spark.createDataFrame([("1,2\t3,28,38,42",), (line,)], "value string").coalesce(1).write.text(str(tmp_path / "t"))
    with pytest.raises(Exception, match="must|malformed"):
        relations.pair_stats(spark, f"file://{tmp_path}/t").collect()


def test_pair_lines_need_no_formatter(spark):
    made = sinks.pair_lines(spark.createDataFrame([(1, 2**62, 3, 4, 5, 6)], "movieI long, movieJ long, commonUsers long, sumXY long, sumX2 long, sumY2 long"))
    assert rows(made) == [(f"1,{2**62}\t3,4,5,6",)]
    assert "format_string" not in made._jdf.queryExecution().executedPlan().toString()


SIMILAR = (relations.similarity, ["1,2\t0.5000000000,3", "1,3\t1.0000000000,3", "1,4\t1,3", "1,5\t 0.25 ,03"], [(1, 2, 0.5, 3, 5 * 10**9), (1, 3, 1.0, 3, 10**10), (1, 4, 1.0, 3, 10**10), (1, 5, 0.25, 3, 25 * 10**8)])
PREDICTED = (relations.predictions, ["1,2\t3.5000000000", "1,3\t5.0000000000", "1,4\t1", " 2,1\t2e0"], [(1, 2, 3.5), (1, 3, 5.0), (1, 4, 1.0), (2, 1, 2.0)])


def test_plain_similarity_lines_are_matched_once(spark, tmp_path):
    _scans_as_before(spark, tmp_path, *SIMILAR)


def test_plain_prediction_lines_are_matched_once(spark, tmp_path):
    _scans_as_before(spark, tmp_path, *PREDICTED)


@pytest.mark.parametrize(("scan", "line"), [
    (relations.similarity, "1,2\t0.0000000000,3"), (relations.similarity, "1,2\t1.0000000001,3"), (relations.similarity, "2,2\t0.5000000000,3"), (relations.similarity, "1,2\t0.5000000000,0"),
    (relations.predictions, "1,2\t5.0000000001"), (relations.predictions, "1,2\t0.9999999999"), (relations.predictions, "1,2\t"), (relations.predictions, "1,2\tInfinity"),
])
def test_other_lines_meet_the_rules(spark, tmp_path, scan, line):
    spark.createDataFrame([(line,)], "value string").write.text(str(tmp_path / "t"))
    with pytest.raises(Exception, match="must|range|fields|can't"):
        scan(spark, f"file://{tmp_path}/t").collect()


def test_ten_decimals_are_those_of_the_digits(spark):
    values = [0.0, 1.0, 9.9999999999, 9.99999999999, 3.33333333335, 1.00000000005, 2.00000000015, 4.99999999995, 0.00000000005, 1e-11, 10.5, 123.45, -1.5, 1 / 3]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    c = F.col("x")
    made = x.select(numbers.ten_text(c), F.format_string("%.10f", c), numbers.ten_rounded(c), F.round(c, 10)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in made) and len(made) == len(values)
    small = x.where("abs(x) < 99")
    assert rows(small.select(numbers.ten_decimals(c))) == rows(small.select((c.cast("decimal(12,10)") * F.lit(10**10)).cast("long")))


def test_best_candidates_and_counts_in_one_pass(spark):
    predicted = spark.createDataFrame([(1, m, s) for m, s in ((5, 3.0), (4, 3.0), (7, 4.5), (8, 4.0), (9, 1.0))] + [(2, 5, 3.0)], "userId long, movieId long, score double")
    ratings = spark.createDataFrame([(1, 8, 3), (2, 5, 1)], "userId long, movieId long, rating int")
    found = topk.best(predicted, ratings, 3)
    assert [(r.userId, r.predictions, r.watched, [tuple(b) for b in r.best]) for r in found.orderBy("userId").collect()] == [(1, 5, 1, [(1, 7, 4.5), (2, 4, 3.0), (3, 5, 3.0)]), (2, 1, 1, [])]
    assert rows(found.select("userId", F.inline("best"))) == rows(topk.recommendations(predicted, ratings, 3))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
