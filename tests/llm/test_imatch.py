import duckdb
from ravelin.llm import imatch, queries


def test_against_sql(spark, prose, odd_rows):
    rows = [(i, prose(i % 25, 40 + i)) for i in range(10, 120)] + [(7, prose(7, 50)), (7, prose(8, 50))] + odd_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "'x' AS rv_x")
    got = imatch.edited_fingerprints(docs)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    duck = duckdb.connect()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841  (read by name)
    expected = duck.sql(queries.oracle_sql()["op3_imatch"])
    names = sorted(got.columns)
    assert sorted(expected.columns) == names
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(r) for r in expected.select(*names).fetchall())


def test_equal_texts_and_likeness(spark, prose):
    rows = [(i, prose(i, 120)) for i in range(60)] + [(100, prose(5, 120)), (101, prose(5, 120) + " extra")]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].fingerprint == got[5].fingerprint and got[101].fingerprint is not None
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    mean = lambda k: sum(getattr(r, k) for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next")


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    r = imatch.edited_fingerprints(docs).first()
    assert r.n_chars == 8 and r.near_next == 1.0
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert [x.near_next for x in imatch.edited_fingerprints(two).collect()] == [1.0, 1.0]


def test_lexicon_is_bounded(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(imatch, "LEXICON", 150)
    assert len(imatch.lexicon(docs)) <= 150
    assert 0 < len(imatch.lexicon(docs)) and imatch.lexicon(docs.limit(0)) == []


def test_lexicon_does_not_shrink_with_long_texts(spark):
    """The band follows from document frequencies, not from the length of the texts."""
    rows = [(i, " ".join(f"w{(i * 613 + k) % 4000}" for k in range(600))) for i in range(60)]
    assert len(imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string"))) > 500
