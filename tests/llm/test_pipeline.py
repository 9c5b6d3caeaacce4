import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F
from ravelin.llm import decontaminate, neardup, quality, toxicity
from ravelin.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_filter_by_their_operators(spark, docs):
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.collect()
    model = toxicity.fit(docs, labels, toxicity.training_rows())
    scores = model.score([toxicity.words(r.text.encode()) for r in rows])
    kept = p.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted(r.doc_id for r, s in zip(rows, scores) if s < model.thresholds.get(r.lang, model.thresholds[None]))
    kept = p.drop_poor(spark, docs, SF)
    model = quality.fit(docs, labels, quality.training_rows())
    assert kept.columns == docs.columns and ids(kept) == sorted(r.doc_id for r in rows if model.score(quality.statistics(r.text.encode())[None])[0] >= p.LEAST_QUALITY)
    kept = p.drop_leaks(spark, docs, SF)
    block = decontaminate.Block([(r.item_id, r.text) for r in bench.collect()])
    assert kept.columns == docs.columns and ids(kept) == sorted(r.doc_id for r in rows if not block.hits(r.text))
    kept = p.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == sorted({r.class_id for r in neardup.classes(docs).collect()})


def test_run(spark):
    out = p.run(spark, SF)
    assert 0 < out.count() < 200 and out.where("NOT round_trip OR n_tokens != size(ids)").count() == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "byte_level_bpe"]


def test_odd_documents(spark, odd_rows):
    docs = spark.createDataFrame([(*r, None, None, None) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() <= len(odd_rows) and stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    names = sorted(got.columns)
    expected = c.sql(oracle_sql()[name])
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(r) for r in expected.select(*names).fetchall())
