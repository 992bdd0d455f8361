"""Strict scans, duplicate rules and writers."""

import datetime as dt

import pytest
from conftest import rows

from tessera.functions import checks, numbers
from tessera.sources import raw, relations, sinks

HEADER = "userId,movieId,rating,date\n"


@pytest.fixture
def put(tmp_path):
    def write(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write


def test_ratings_skip_the_header_and_repeats(spark, put):
    path = put("r.csv", HEADER + "101,3,5,2005-01-03\n101,1,+4,2005-01-01\n" + HEADER + "101,3,5,2005-01-03\n")
    found = relations.unique_ratings(relations.ratings(spark, path))
    assert rows(found) == [(101, 1, 4, dt.date(2005, 1, 1)), (101, 3, 5, dt.date(2005, 1, 3))]
    assert [r.value for r in sinks.history_lines(found).collect()] == ["101\t1:4,3:5"]


@pytest.mark.parametrize("row", ["0,1,5,2005-01-01", "01,1,5,2005-01-01", "+1,1,5,2005-01-01", "1,1,6,2005-01-01", "1,1,0,2005-01-01", "1,1,x,2005-01-01", "1,1,5,2005-1-1", "1,1,5,2005-02-30", "1,1,5", "1,1,5,2005-01-01,9", "", "9223372036854775808,1,5,2005-01-01"])
def test_malformed_ratings_fail_with_the_row(spark, put, row):
    with pytest.raises(Exception, match="must") as e:
        relations.ratings(spark, put("r.csv", HEADER + row + "\n1,2,3,2005-01-01\n")).collect()
    assert row in str(e.value)


def test_conflicting_ratings_fail(spark, put):
    with pytest.raises(Exception, match="conflicting ratings for 101,1"):
        relations.unique_ratings(relations.ratings(spark, put("r.csv", "101,1,4,2005-01-01\n101,1,5,2005-01-01\n"))).collect()


def test_csv_header_must_come_first(spark, put):
    assert rows(relations.csv_ratings(spark, put("a.csv", HEADER + "007,1,5,2005-01-01\n")), "userId") == [(7,)]
    with pytest.raises(Exception, match="first line"):
        relations.csv_ratings(spark, put("b.csv", "1,1,5,2005-01-01\n")).collect()
    for n, text in enumerate(("1,1,5,2005-01-01\n" + HEADER, HEADER + "1,1,5,2005-01-01\n" + HEADER, "\n" + HEADER)):
        with pytest.raises(Exception, match="first line"):
            relations.csv_ratings(spark, put(f"c{n}.csv", text)).collect()
    assert rows(relations.csv_ratings(spark, put("d.csv", "\ufeff" + HEADER + "7,1,5,2005-01-01\r\n8,1,5,2005-01-01")), "userId") == [(7,), (8,)]


def test_header_of_split_files(spark, put, monkeypatch):
    """Files larger than a split: the header is told by each file's first split, and no file is read as one record."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for i in range(3):
            put(f"many/f{i}.csv", HEADER + "".join(f"{1000 * i + n},{n},5,2005-01-01\n" for n in range(1, 301)))
        found = relations.csv_ratings(spark, put("many/f3.csv", HEADER).rsplit("/", 1)[0])
        assert found.count() == 900 and spark.read.text(put("many/f3.csv", HEADER).rsplit("/", 1)[0]).rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_timestamped(spark, put):
    head = "userId,movieId,rating,timestamp,dateTimeUtc,date\n"
    assert rows(relations.timestamped(spark, put("a.csv", head + "1,2,5,978300760,2000-12-31T22:12:40Z,2000-12-31\n")), "timestamp") == [(978300760,)]
    with pytest.raises(Exception, match="follow"):
        relations.timestamped(spark, put("b.csv", head + "1,2,5,978300760,2000-12-31T22:12:41Z,2000-12-31\n")).collect()
    with pytest.raises(Exception, match="conflicting"):
        relations.timestamped(spark, put("c.csv", head + "1,2,5,978300760,2000-12-31T22:12:40Z,2000-12-31\n" * 2)).collect()


def test_relations_round_trip(spark, put, tmp_path):
    history = relations.history(spark, put("h", "101\t1:4,3:5\n102\t2:5\n"))
    assert rows(history) == [(101, 1, 4), (101, 3, 5), (102, 2, 5)]
    pairs = relations.pair_stats(spark, put("p", "1,2\t3,28,38,42\n"))
    assert rows(pairs) == [(1, 2, 3, 28, 38, 42)]
    similar = relations.similarity(spark, put("s", "1,2\t0.8000000000,3\n"))
    assert rows(similar) == [(1, 2, 0.8, 3, 8 * 10**9)]
    predicted = relations.predictions(spark, put("q", "1,2\t3.8000000000\n1,2\t3.8000000000\n"))
    assert rows(predicted) == [(1, 2, 3.8)]
    recommended = relations.recommendations(spark, put("t", "101\t3:3.8000000000,4:3.0000000000\n"), 2)
    assert rows(recommended) == [(101, 1, 3, 3.8), (101, 2, 4, 3.0)]
    for lines, again in ((sinks.pair_lines(pairs), relations.pair_stats), (sinks.similarity_lines(similar), relations.similarity), (sinks.prediction_lines(predicted), relations.predictions), (sinks.recommendation_lines(recommended), relations.recommendations)):
        path = str(tmp_path / again.__name__)
        sinks.write_text(lines, path, one_file=True)
        assert again(spark, path).count() == (2 if again is relations.recommendations else 1)
        with pytest.raises(Exception, match="already exists"):
            sinks.write_text(lines, path)


@pytest.mark.parametrize(("scan", "line"), [
    (relations.history, "102\t1:3,1:5"), (relations.history, "102\t1-3"), (relations.history, "102"), (relations.pair_stats, "2,1\t3,28,38,42"), (relations.pair_stats, "1,2\t0,28,38,42"), (relations.pair_stats, "1,2,3\t28,38,42"),
    (relations.similarity, "2,2\t0.5,1"), (relations.similarity, "1,2\t0.0,1"), (relations.similarity, "1,2\t1.5,1"), (relations.similarity, "1,2\tNaN,1"), (relations.predictions, "1,2\t6.0"),
    (relations.predictions, "1,2\t3.8\n1,2\t3.7"), (relations.recommendations, "1\t3:3.0,4:3.8"), (relations.recommendations, "1\t4:3.0,3:3.0"), (relations.recommendations, "1\t3:3.0,3:3.0"), (relations.recommendations, "1\t3:5.5"), (relations.recommendations, "1\t3:3.0\n1\t3:3.0"),
])
def test_malformed_relations_fail(spark, put, scan, line):
    with pytest.raises(Exception, match="must|repeated|conflicting|malformed|range|can't"):
        scan(spark, put("x", line + "\n")).collect()


def test_part_files(spark, put, tmp_path):
    for name, text in (("part-00000", "a\n\n"), ("part-00001.txt", "b\n"), ("run.log", "no\n"), ("_SUCCESS", "no\n"), (".part-0.crc", "no\n"), ("catalog", "c\n")):
        put(f"parts/{name}", text)
    assert rows(relations.lines(spark, str(tmp_path / "parts"))) == [("",), ("a",), ("b",), ("c",)]


def test_header_blocks(spark, put, tmp_path):
    put("n/mv_0000001.txt", "1:\n1488844,3,2005-09-06\n822109,5,2005-05-13\n\n2:\n1488844,4,2005-09-07\n1488844,4,2005-09-07\n0:\nx:\n5,6,2005-01-01\n5,1\n")
    put("n/deep/mv_0000002.txt", "7,3,2005-01-01\n-3:\n3:\n0,1,2005-01-01\n9,1,2005-13-01\n9,1,2005-12-01")
    found = raw.header_blocks(spark, str(tmp_path / "n"))
    assert rows(raw.header_block_ratings(found), "userId", "movieId", "rating") == [(9, 3, 1), (822109, 1, 5), (1488844, 1, 3), (1488844, 2, 4)]
    s = raw.header_block_stats(found).first().asDict()
    assert (s["files_processed"], s["movie_headers"], s["input_rating_rows"], s["valid_rating_rows"], s["blank_lines"], s["duplicate_rows_removed"], s["output_rows"]) == (2, 3, 13, 5, 1, 1, 4)
    assert [s[r] for r in raw.REJECT_REASONS] == [1, 1, 1, 1, 1, 1, 2]
    # the first file by path is deep/mv_0000002.txt
    assert raw.sniff(spark, str(tmp_path / "n")) == "three-column"
    put("o/mv_0000001.txt", "\n 1:\n5,3,2005-01-01\n")
    assert raw.sniff(spark, str(tmp_path / "o")) == "header-block"
    put("z/mv_0000001.txt", "a;b\n")
    with pytest.raises(ValueError, match="unknown"):
        raw.sniff(spark, str(tmp_path / "z"))


def test_colon_files(spark, put):
    ratings = raw.colon_ratings(spark, put("ratings.dat", "1::1193::5::978300760\n1::1193::5::978300760\n2::661::3::978302109\n"))
    assert rows(ratings, "userId", "movieId", "date") == [(1, 1193, "2000-12-31"), (2, 661, "2000-12-31")]
    movies = raw.colon_movies(spark, put("movies.dat", "1::Café (1995)::Animation|Comedy\n2::No year::Drama\n", "latin-1"))
    assert rows(movies) == [(1, "Café", 1995, "Animation|Comedy"), (2, "No year", None, "Drama")]
    assert rows(raw.colon_users(spark, put("users.dat", "1::F::1::10::48067\n")), "gender", "age") == [("F", 1)]
    for scan, line in ((raw.colon_ratings, "1::1::5"), (raw.colon_ratings, "1::1::5::9\n1::1::4::9"), (raw.colon_users, "1::X::1::10::4"), (raw.colon_movies, "1::A::B\n1::A::B")):
        with pytest.raises(Exception, match="must|conflicting|repeated"):
            scan(spark, put("bad.dat", line + "\n")).collect()


def test_three_columns_and_titles(spark, put, tmp_path):
    for i in (1, 2, 3):
        put(f"t/mv_{i:07d}.txt", f"10,{i},4\n\n11,{i},5\n10,{i},4\n")
    assert raw.file_set(spark, str(tmp_path / "t"), 3)[-1] == "mv_0000003.txt"
    with pytest.raises(ValueError, match="missing"):
        raw.file_set(spark, str(tmp_path / "t"))
    found = raw.three_columns(spark, str(tmp_path / "t"))
    assert found.count() == 6 and raw.sniff(spark, str(tmp_path / "t")) == "three-column"
    assert rows(raw.with_no_date(found), "date")[0] == (dt.date(1970, 1, 1),)
    put("w/mv_0000001.txt", "10,2,4\n")
    with pytest.raises(Exception, match="file's"):
        raw.three_columns(spark, str(tmp_path / "w")).collect()
    assert rows(raw.movie_titles(spark, put("m.txt", "1,Fixture Movie 1\n2,2003,Good, Bad\n3,,None\n"))) == [(1, "Fixture Movie 1", None), (2, "Good, Bad", 2003), (3, "None", None)]
    with pytest.raises(Exception, match="must"):
        raw.movie_titles(spark, put("m2.txt", "1,20x3,Title\n")).collect()


def test_metadata_and_results(spark, put):
    assert rows(relations.metadata(spark, put("m.csv", "movieId,title,year,genres\n1,A,,X|Y\n2,B,1999,\n"))) == [(1, "A", None, "X|Y"), (2, "B", 1999, "")]
    with pytest.raises(Exception, match="year"):
        relations.metadata(spark, put("m2.csv", "movieId,title,year\n1,A,99\n")).collect()
    ok = relations.evaluation_metrics(spark, put("e.json", '{"mae": null, "prediction_coverage": 0.5, "test_rows": 4}'))
    assert ok.first().prediction_coverage == 0.5
    with pytest.raises(Exception, match="range"):
        relations.evaluation_metrics(spark, put("e2.json", '{"prediction_coverage": 1.5}')).collect()


def test_duplicate_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert rows(checks.one_per_key(df, ["k"], ["v"], "x")) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="x for 1"):
        checks.one_per_key(df, ["k"], ["v"], "x", identical="fail").collect()
    more = df.union(spark.createDataFrame([(2, "c")], df.schema))
    assert rows(checks.one_per_key(more, ["k"], ["v"], "x", conflicting="keep")) == [(1, "a"), (2, "b"), (2, "c")]


def test_ten_decimals_round_half_up(spark):
    df = spark.createDataFrame([(0.00048828125,), (1.0,), (2 / 3,)], "x double")
    assert [r[0] for r in df.select(numbers.ten_decimals(df.x)).collect()] == [4882813, 10**10, 6666666667]
    assert [r[0] for r in df.select(numbers.ten_text(df.x)).collect()][0] == "0.0004882813"
    texts = spark.createDataFrame([("1.5",), ("",), ("x",), ("NaN",), ("Infinity",)], "t string")
    assert [r[0] for r in texts.select(numbers.lenient_double(texts.t)).collect()] == [1.5, None, None, None, None]


def test_one_plain_column_per_key(spark):
    """A null beside a value is a conflict, nulls alone are not; NaN equals itself."""
    df = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    assert rows(checks.one_per_key(df((1, 2.0), (1, 2.0), (2, None), (2, None)), ["k"], ["v"], "x")) == [(1, 2.0), (2, None)]
    for r in (((1, 2.0), (1, None)), ((1, 2.0), (1, 3.0)), ((1, float("nan")), (1, 3.0))):
        with pytest.raises(Exception, match="x for 1"):
            checks.one_per_key(df(*r), ["k"], ["v"], "x").collect()
    assert checks.one_per_key(df((1, float("nan")), (1, float("nan"))), ["k"], ["v"], "x").count() == 1


def test_repeated_history_lines_fail(spark, put):
    with pytest.raises(Exception, match="repeated"):
        relations.history(spark, put("h", "1\t1:4\n1\t1:4\n")).collect()
    with pytest.raises(Exception, match="repeated"):
        relations.history(spark, put("h2", "1\t1:4, 1:5\n")).collect()
    assert "collect_list" not in (plan := relations.history(spark, put("h3", "1\t1:4,2:5\n"))._jdf.queryExecution().optimizedPlan().toString()) and plan.index("Aggregate") > plan.index("Generate")
