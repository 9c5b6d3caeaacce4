import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.llm import quality, toxicity

BAD = ["foulword", "nastything", "rotten"]


def auc(p, y):
    p, y = np.asarray(p), np.asarray(y)
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


@pytest.fixture(scope="module")
def data(spark, prose):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = prose(i, r.randint(20, 120)).split()
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "er"]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), ["en", "de"][i % 2]))
        labels.append((i, int(not poor), int(toxic)))
    labels += [(1, 1, 0), (None, 1, 1), (2, None, None), (99_999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def toxic_model(data):
    return toxicity.fit(*data, toxicity.training_rows())


@pytest.fixture(scope="module")
def quality_model(data):
    return quality.fit(*data, quality.training_rows())


def test_toxicity_on_held_out_rows(spark, data, toxic_model):
    docs, _ = data
    got = docs.where(~toxicity.training_rows()).select("doc_id", toxicity.score(toxic_model, F.col("text"), spark).alias("p")).collect()
    assert auc([r.p for r in got], [r.doc_id % 4 == 0 for r in got]) > 0.97 and all(0 <= r.p <= 1 for r in got)
    assert {None, "en", "de"} >= set(toxic_model.thresholds)


def test_toxicity_of_odd_rows(spark, toxic_model, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))
    p = toxicity.score(toxic_model, F.col("text"), spark)
    got = [(r.text, r.p, r.f) for r in df.select("text", p.alias("p"), F.col("lang")).withColumn("f", toxicity.flag(toxic_model, F.col("p"), F.col("lang"))).collect()]
    assert len(got) == len(odd_rows) and len({x[1] for x in got if not (x[0] or "").strip()}) == 1
    assert df.limit(0).select(p).count() == 0


def test_long_texts_are_scored_whole(toxic_model, monkeypatch):
    text = ("word " * 3000 + "foulword nastything ").encode()
    whole = toxic_model.score([toxicity.words(text)])
    monkeypatch.setattr(toxicity, "RUN_WORDS", 100)
    parts = toxic_model.score([toxicity.words(text), toxicity.words(b""), toxicity.words(text)])
    assert np.allclose(whole[0], parts[[0, 2]], atol=1e-5)
    assert whole[0] > toxic_model.score([toxicity.words(b"word " * 3000)])[0]


def test_one_class_or_no_rows(spark, data):
    docs, labels = data
    assert toxicity.fit(docs, labels, F.lit(False)).constant == 0.5
    assert toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True)).constant > 0.9
    m = quality.fit(docs, labels, F.lit(False))
    assert m.score(np.zeros((2, quality.STATISTICS))).tolist() == [0.5, 0.5]
    assert quality.fit(docs, labels.where("quality = 1"), F.lit(True)).values[0] > 0.9


def test_training_rows(spark, data):
    got = data[0].select("doc_id", toxicity.training_rows().alias("t"), quality.training_rows().alias("q")).collect()
    assert all(r.t == (crc32(str(r.doc_id).encode()) % 3 != 1) and r.q == (crc32(str(r.doc_id).encode()) % 4 != 2) for r in got)


def test_quality_on_held_out_rows(spark, data, quality_model):
    docs, _ = data
    got = docs.where(~quality.training_rows()).select("doc_id", quality.score(quality_model, F.col("text"), spark).alias("p")).collect()
    assert auc([r.p for r in got], [r.doc_id % 5 != 0 for r in got]) > 0.99
    assert np.mean([(r.p >= 0.7) == (r.doc_id % 5 != 0) for r in got]) > 0.97


def test_quality_of_odd_rows(spark, quality_model, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("x", F.lit("clash"))
    got = df.select("text", quality.score(quality_model, F.col("text"), spark).alias("p")).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.p <= 1 for r in got)
    assert len({r.p for r in got if not r.text}) == 1
    assert df.limit(0).select(quality.score(quality_model, F.col("text"), spark)).count() == 0


def test_isotonic_against_brute_force():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 8, 40).astype(float), r.integers(0, 2, 40).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    means = [np.mean(y[x == v]) for v in sorted(set(x))]
    if all(a <= b for a, b in zip(means, means[1:])):
        assert len(knots) == 2 * len(means)


def test_normal_equations_equal_a_direct_fit(data, quality_model):
    docs, labels = data
    rows = [r for r in docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id").where(quality.training_rows()).collect() if r.q is not None]
    fit = [r for r in rows if crc32(r.text.encode()) % 4]
    a = quality_model.cosines(np.stack([quality.statistics(r.text.encode()) for r in fit]))
    y = np.array([float(r.q) for r in fit])
    w = np.linalg.solve(a.T @ a + quality.RIDGE * len(y) * np.eye(a.shape[1]), a.T @ y)
    assert np.allclose(w, quality_model.weight, atol=1e-6)


def test_scores_keep_the_share_of_toxic_rows_beyond_the_sample():
    """The same scores, with clean rows thinned to a ninth: the fit and the cut are those of all rows."""
    r = np.random.default_rng(4)
    z = np.concatenate([r.normal(-1, 1, 9000), r.normal(1, 1, 1000)])
    y = np.repeat([0.0, 1.0], [9000, 1000])
    some = np.concatenate([np.arange(0, 9000, 9), np.arange(9000, 10000)])
    stands = np.where(y[some] > 0, 1.0, 9.0)
    whole, thin = toxicity._platt(z, y), toxicity._platt(z[some], y[some], stands)
    assert np.allclose(whole, thin, atol=0.3) and abs(toxicity._platt(z[some], y[some])[1] - whole[1]) > 1.5
    assert abs(toxicity._best_cut(z[some], y[some], stands) - toxicity._best_cut(z, y)) < 0.3


def test_a_capped_sample_keeps_the_prior(spark):
    """900 clean and 100 toxic rows that words tell apart badly: with 100 of each learnt from, the mean score stays near a tenth."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 30, 12)), "en", int(i % 10 == 0)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), F.lit(True), rows=100)
    assert model.score([toxicity.words(t.encode()) for _, t, _, _ in rows]).mean() < 0.3


def test_maxima_against_a_naive_convolution():
    from ravelin.llm import toxicity as x

    r = np.random.default_rng(1)
    taps = r.normal(size=(x.BUCKETS, sum(x.SPANS) * x.FILTERS)).astype(np.float32)
    taps[0] = 0
    model = x.Model(taps, r.normal(size=len(x.SPANS) * x.FILTERS).astype(np.float32), np.zeros(len(x.SPANS) * x.FILTERS), 0.0)
    texts = [x.words(t) for t in (b"", b"one", b"one two", b"a bad word and a good word and the end")]
    got = model.maxima(texts)
    for i, ids in enumerate(texts):
        padded = np.concatenate([ids if len(ids) else x._padding(1), x._padding(max(x.SPANS) - 1)])
        at = 0
        for s, span in enumerate(x.SPANS):
            for f in range(x.FILTERS):
                best = max(model.bias[s * x.FILTERS + f] + sum(taps[w, at + j * x.FILTERS + f] for j in range(span) for w in padded[start + j]) for start in range(max(1, len(ids))))
                assert abs(got[i, s * x.FILTERS + f] - max(best, 0)) < 1e-3
            at += span * x.FILTERS


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_against_the_min_max_formula(seed):
    """Every value is the largest over beginnings of the smallest mean over ends; pools are smoothed by half a row of either class, never downwards."""
    r = np.random.default_rng(seed)
    x = r.permutation(40).astype(float)
    y = (r.random(40) < 0.2 + x / 60).astype(float)
    order = np.argsort(x)
    s = y[order]
    fit = [max(min(s[a:b].mean() for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    knots, values = quality.isotonic(x, y)
    smooth = [(sum(pool) + 0.5) / (len(pool) + 1) for i in range(40) for pool in [[s[j] for j in range(40) if abs(fit[j] - fit[i]) < 1e-12]]]
    assert np.allclose(np.interp(np.arange(40), knots, values), np.maximum.accumulate(smooth))


def test_toxicity_is_learnt_from_all_labelled_rows(spark):
    """Only 2,000 rows of each class, those with the smallest hash of their id, were learnt from: words of other toxic rows stayed unknown."""
    r = np.random.default_rng(6)
    ids = spark.range(5000).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    toxic, clean = ids[:2500], ids[2500:]
    bad = {i: "zonk" if n >= 2000 else "evil" for n, i in enumerate(toxic)}
    rows = [(i, " ".join([f"w{k}" for k in r.integers(0, 60, 8)] + ([bad[i]] if i in bad else [])), "en", int(i in bad)) for i in toxic + clean]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), F.lit(True))
    plain, evil, zonk = model.score([toxicity.words(t) for t in (b"w1 w2 w3 w4", b"w1 w2 evil w3 w4", b"w1 w2 zonk w3 w4")])
    assert plain < 0.5 < min(evil, zonk)


def test_parts_are_averaged(spark, data, monkeypatch):
    """Rows in several parts, each passed over by a task of its own, teach what one part does; the same on every run."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    monkeypatch.setattr(toxicity, "PASSES", (4, 20))
    docs, labels = data
    model = toxicity.fit(docs, labels, toxicity.training_rows())
    got = docs.where(~toxicity.training_rows()).collect()
    p = model.score([toxicity.words(r.text.encode()) for r in got])
    assert auc(p, [r.doc_id % 4 == 0 for r in got]) > 0.97 and {None, "en", "de"} >= set(model.thresholds)
    assert toxicity.fit(docs, labels, toxicity.training_rows()).score([toxicity.words(r.text.encode()) for r in got]).tolist() == p.tolist()


def test_counted_logits_calibrate_like_their_rows():
    r = np.random.default_rng(8)
    z, y = np.rint(r.normal(0, 2, 3000)), (r.random(3000) < 0.3).astype(float)
    pairs, n = np.unique(np.stack([z, y], axis=1), axis=0, return_counts=True)
    assert np.allclose(toxicity._platt(z, y), toxicity._platt(pairs[:, 0], pairs[:, 1], n.astype(float)), atol=0.02)
