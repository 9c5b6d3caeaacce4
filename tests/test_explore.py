import json
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from ravelin.operators import explore, layout
from ravelin.sources import files

REVIEWS = [
    ("u1", "b1", "2018-03-01", 5.0), ("u1", "b2", "2018-07-04", 2.0), ("u2", "b1", "2017-12-31", 4.0), ("u2", "b3", "2018-01-01", 4.0), ("u3", "b1", "2016-05-05", 3.0),
    ("u3", "b4", "2018-02-02", None), ("u1", "b3", "2019-01-01", 3.0), ("u4", "b5", "2018-11-11", 4.0), ("u5", "bX", "2018-01-02", 1.0),
]
BUSINESSES = [("b1", "Toronto"), ("b2", "Phoenix"), ("b3", "phoenix"), ("b4", "Mesa"), ("b5", "Akron"), ("b6", "Empty")]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(REVIEWS, "user_id string, business_id string, date string, stars double")


@pytest.fixture(scope="module")
def businesses(spark):
    return spark.createDataFrame(BUSINESSES, "business_id string, city string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_summary(reviews):
    assert rows(explore.review_summary(reviews)) == [(9, 6, 5, 6)]
    assert explore.reviews_in_year(reviews).count() == 6
    assert rows(explore.review_summary(reviews.limit(0))) == [(0, 0, 0, 0)]


def test_dense_summary(spark):
    """The same as with distinct counts, whatever the words hold; null ids and an empty table; no row is expanded."""
    made = [(k * 7 % 200, k * k % 131, f"{2016 + k % 4}-01-01") for k in range(900)] + [(None, 5, "2018-05-05"), (63, None, None), (64, 0, "2018")]
    df = spark.createDataFrame(made, "user_id long, business_id long, date string")
    got = explore.review_summary_dense(df)
    assert rows(got) == rows(explore.review_summary(df)) and rows(explore.review_summary_dense(df.limit(0))) == [(0, 0, 0, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan


def test_rankings_break_ties_by_id(reviews):
    assert rows(explore.top(reviews, "user_id")) == [("u1", 3), ("u2", 2), ("u3", 2), ("u4", 1), ("u5", 1)]
    assert rows(explore.top(reviews, "business_id", 3)) == [("b1", 3), ("b3", 2), ("b2", 1)]


def test_top_is_planned_as_take_ordered(reviews):
    assert "TakeOrderedAndProject" in explore.top(reviews, "user_id")._jdf.queryExecution().executedPlan().toString()


def test_city_stars(reviews, businesses):
    expected = [("Akron", 4.0), ("Toronto", 4.0), ("phoenix", 3.5), ("Phoenix", 2.0)]
    assert rows(explore.city_stars(businesses, reviews)) == expected
    assert rows(explore.city_stars(businesses, reviews, order_by_exact=True, rounding="half_up")) == expected
    assert explore.business_reviews(businesses, reviews).where("business_id = 'b6'").collect()[0].stars is None


def test_city_join_is_inner_after_the_null_filter(reviews, businesses):
    assert "LeftOuter" not in explore.city_stars(businesses, reviews)._jdf.queryExecution().optimizedPlan().toString()


def test_null_city_is_a_group_and_last(spark, reviews):
    cities = spark.createDataFrame([("b1", None), ("b2", "Z")], "business_id string, city string")
    assert rows(explore.city_stars(cities, reviews)) == [(None, 4.0), ("Z", 2.0)]


def test_report_document(reviews, tmp_path):
    files.write_document(explore.report(reviews), str(tmp_path / "out.json"))
    got = json.loads((tmp_path / "out.json").read_text())
    assert got["n_review_2018"] == 6 and got["top10_user"][0] == ["u1", 3]


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text("".join(json.dumps({"user_id": u, "business_id": b, "date": d, "stars": s, "more": 1}) + "\n" for u, b, d, s in REVIEWS))
    (tmp_path / "b.json").write_text("".join(json.dumps({"business_id": b, "city": c}) + "\n" for b, c in BUSINESSES))
    assert rows(explore.review_summary(files.reviews(spark, str(tmp_path / "r.json")))) == [(9, 6, 5, 6)]
    assert files.review_businesses(spark, str(tmp_path / "r.json")).columns == ["business_id"]
    found = explore.city_stars(files.businesses(spark, str(tmp_path / "b.json")), files.review_stars(spark, str(tmp_path / "r.json")))
    files.write_city_stars(found, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    files.write_city_stars_text(found, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "Akron,4.0"


@pytest.mark.parametrize("line", ["{not json", '{"user_id": "u", "business_id": "b"}'])
def test_malformed_json_raises(spark, tmp_path, line):
    (tmp_path / "bad.json").write_text(line + "\n")
    with pytest.raises(Exception):  # noqa: B017
        files.reviews(spark, str(tmp_path / "bad.json")).collect()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("user_id,business_id\nu1,b1\nu2,b2\n")
    assert files.pairs(spark, str(tmp_path / "p.csv")).count() == 2
    (tmp_path / "t.csv").write_text("user_id,business_id,stars\nu1,b1,4.5\n")
    assert rows(files.ratings(spark, str(tmp_path / "t.csv"))) == [("u1", "b1", 4.5)]
    (tmp_path / "empty.csv").write_text("user_id,business_id\n")
    assert files.pairs(spark, str(tmp_path / "empty.csv")).count() == 0
    assert files.spread(files.pairs(spark, str(tmp_path / "p.csv"))).rdd.getNumPartitions() == 2


def test_first_key_at_any_depth(spark, tmp_path):
    """In document order, not in that of the keys; keys in texts and values do not count; escapes are read."""
    lines = ['{"z": {"business_id": "b1"}, "business_id": "b2"}', '[{"a": "business_id"}, {"t": "\\\\", "u": "\\"business_id\\": 1", "business_id" : "b\\u00e93\\n"}]', '{"business_id": "b4", "rest": [{', '{"business_idx": 1, "x": {"y": [[], {"business_id": ""}]}}']
    (tmp_path / "n.json").write_text("\n".join(lines) + "\n")
    got = [r.business_id for r in files.first_at_any_depth(spark, str(tmp_path / "n.json")).collect()]
    assert got == ["b1", "b\u00e93\n", "b4", ""]
    for bad, what in [('{"a": 1}', "missing business_id"), ('{"business_id": 7}', "not a string"), ('{"business_id": {"business_id": "x"}}', "not a string"), ('{"business_id":', "not a string"), ("", "missing")]:
        (tmp_path / "bad.json").write_text(bad + "\n")
        with pytest.raises(Exception, match=what):
            files.first_at_any_depth(spark, str(tmp_path / "bad.json")).collect()


def test_rows_lie_where_their_key_says(spark):
    """Every row in the partition that crc32 names, and ranges that overlap are counted."""
    counts = spark.createDataFrame([(f"b{k}", k % 9) for k in range(200)] + [(None, 3)], "business_id string, n int")
    got = layout.dealt(counts, 5, "business_id").select("business_id", F.spark_partition_id().alias("p")).collect()
    assert {(r.business_id, r.p) for r in got} == {(f"b{k}", crc32(f"b{k}".encode()) % 5) for k in range(200)} | {(None, 0)}
    assert rows(layout.range_order(layout.ranged(counts, 5), 5)) == [(5, 201, 0)]
    assert layout.range_order(layout.dealt(counts, 5, "business_id"), 5).first().overlaps > 0


def test_layouts(reviews):
    counts = explore.counts(reviews, "business_id")
    got = layout.partition_profile(counts, 3)
    sums = {r.layout: r.n for r in got.groupBy("layout").agg({"n_items": "sum"}).withColumnRenamed("sum(n_items)", "n").collect()}
    assert sums == {"hash": 6, "range": 6} and got.count() == 6
    compared = layout.compare_partitioners(counts, 3)
    assert compared["customized"]["n_partition"] == 3 and sum(compared["default"]["n_items"]) == 6
    assert set(layout.compare_fetches(counts)) == {"m1", "m2", "explanation"}


def test_stream_counts(spark, tmp_path):
    from ravelin.streaming.reviews import review_stream, running_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("".join(json.dumps({"user_id": u, "business_id": b, "date": d}) + "\n" for u, b, d, _ in REVIEWS))
    q = running_counts(review_stream(spark, str(tmp_path / "in")), "user_id").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: r.n for r in spark.table("running").collect()} == {"u1": 3, "u2": 2, "u3": 2, "u4": 1, "u5": 1}
