import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.llm import brown


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [""]


@pytest.fixture(scope="module")
def scored(spark, prose, odd_rows):
    rows = [(i, prose(i, 60 + i)) for i in range(10, 90)] + odd_rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = brown.fit(df, brown.training_rows())
    out = brown.score(model, df, {"doc_id": F.col("doc_id"), "t": F.col("text")}).collect()
    return rows, model, out


def test_base_score_and_counts(scored):
    rows, model, out = scored
    learnt = Counter(w for i, t in rows if crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(learnt.values()), len(learnt)
    assert (model.tokens, model.types) == (n, v) and len(out) == len(rows)
    for r in out:
        w = tokens(r.t)
        assert r.n_tokens == len(w) and r.n_known == sum(learnt[x] > 0 for x in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((learnt[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score)


def test_score_against_the_formula_and_the_tail_join(spark, scored, monkeypatch):
    """With a core of few words most go through the join; scores must not change."""
    rows, _, out = scored
    monkeypatch.setattr(brown, "CORE", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown.fit(df, brown.training_rows())
    assert 0 < len(model.core) <= 20
    again = brown.score(model, df, {"t": F.col("text")}).collect()
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    top = {w: i for i, w in enumerate(model.core)}
    for r in again:
        w = [x.encode() for x in tokens(r.t)]
        kinds = [0] + [int(0 if not x else model.core_class[top[x]] if x in top else model.of[brown.ending_unit(x)]) for x in w]
        p = 0.0
        for a, b, x in zip(kinds, kinds[1:], w):
            p += model.step[a, b] + (0 if not x else math.log10(counts[x] - model.discount[b]) - math.log10(model.total[b]) if x in counts else model.unknown[b])
        assert math.isclose(p, r.score, rel_tol=1e-9)


def test_probabilities_sum_to_one(scored):
    _, model, _ = scored
    assert np.allclose((10**model.step).sum(1), 1)
    mass = np.zeros(brown.CLASSES)
    top = {w: i for i, w in enumerate(model.core)}
    for r in model.counts.collect():
        w = bytes(r.word)
        c = 0 if not w else model.core_class[top[w]] if w in top else model.of[brown.ending_unit(w)]
        mass[c] += (r.n - model.discount[c]) / model.total[c]
    unknown = np.where(np.isfinite(model.unknown), 10**model.unknown, 0)
    assert np.allclose((mass + unknown)[model.total > 0], 1)


def test_beats_the_unigram_base_on_held_out_text(spark):
    import random

    r = random.Random(5)
    kinds = [[f"{p}{i}" for i in range(40)] for p in "abcd"]
    text = lambda: " ".join(r.choice(kinds[(k + s) % 4]) for s in [r.randint(0, 3)] for k in range(80))
    df = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string")
    model = brown.fit(df, brown.training_rows())
    got = brown.score(model, df, {"held": ~brown.training_rows()}).where("held").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]  # log10 probabilities: a quarter of the words follows each word


def test_exchange_finds_the_classes():
    n = 40
    pairs = np.zeros((n, n))
    for a in range(1, n):
        for b in range(1, n):
            pairs[a, b] = 10 if a % 2 != b % 2 else 0
    of = brown.exchange(pairs, classes=3)
    assert of[0] == 0 and len(set(of[1::2])) == 1 and len(set(of[2::2])) == 1 and of[1] != of[2]


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = brown.fit(df, F.lit(False))
    r = brown.score(model, df, {"doc_id": F.col("doc_id")}).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert brown.score(model, df.limit(0), {"doc_id": F.col("doc_id")}).count() == 0


def likelihood(pairs, of, k):
    """Class bigram log likelihood, but for the words' own share, recomputed from the units."""
    t = np.zeros((k, k))
    for a in range(len(pairs)):
        for b in range(len(pairs)):
            t[of[a], of[b]] += pairs[a, b]
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_never_lowers_the_likelihood():
    r = np.random.default_rng(2)
    pairs = r.poisson(r.gamma(0.3, 8, (26, 26))).astype(float)
    scores = [likelihood(pairs, brown.exchange(pairs, classes=5, sweeps=s), 5) for s in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0]
    of = brown.exchange(pairs, classes=5, sweeps=50)
    for u in range(1, 26):  # no single move is better
        for c in range(1, 5):
            other = of.copy()
            other[u] = c
            assert likelihood(pairs, other, 5) <= likelihood(pairs, of, 5) + 1e-6


def test_a_word_moves_to_its_best_class():
    """``moved`` against the likelihood recomputed for every class."""
    r = np.random.default_rng(4)
    k, n = 6, 40
    pairs = r.poisson(r.gamma(0.4, 6, (n, n))).astype(float)
    np.fill_diagonal(pairs, 0)
    of = np.append(0, r.integers(1, k, n - 1))
    t = np.zeros((k, k))
    np.add.at(t, (of[:, None], of[None, :]), pairs)
    for u in range(1, n):
        right, left = np.bincount(of, pairs[u], k), np.bincount(of, pairs[:, u], k)
        got = int(brown.moved(t, of[[u]], right[None], left[None], tried=k - 1)[0])
        best = [likelihood(pairs, np.where(np.arange(n) == u, c, of), k) for c in range(1, k)]
        assert abs(best[got - 1] - max(best)) < 1e-6


def test_words_beyond_the_top_take_their_own_class(spark, monkeypatch):
    """Words that only their neighbours tell apart leave the class of their ending; known words of held-out texts are scored better."""
    import random

    r = random.Random(5)
    kinds = [[f"{''.join(r.choice('abcdefgh') for _ in range(5))}same" for _ in range(60)] for _ in range(4)]
    text = lambda: " ".join(r.choice(kinds[(k + s) % 4]) for s in [r.randint(0, 3)] for k in range(60))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(brown, "TOP_WORDS", 60)
    monkeypatch.setattr(brown, "UNITS", 61 + brown.ENDINGS)
    ask = lambda: brown.score(brown.fit(df, brown.training_rows()), df, {"held": ~brown.training_rows()}).where("held").agg(F.sum("score")).first()[0]
    moved = ask()
    monkeypatch.setattr(brown, "LEAST_COUNT", 10**9)
    assert moved > ask() * 0.9
