import math
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F
from ravelin.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, t in own:
            m, score = 10 + 90 * len(t) * n_docs // n_terms, 0
            for w in set(terms(text)) & set(t):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def found(docs, items, **kw):
    got = search.ranked(docs, items, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in got.collect())


def corpus(prose, n=400):
    r = random.Random(5)
    docs = [(k, prose(r.randrange(60), r.choice([1, 5, 30, 200])) + f" own{k % 50} " + "the " * r.randrange(9)) for k in range(n)]
    items = [(k, prose(k, 40) + " the") for k in range(15)] + [(90, "nothing-of-this-kind"), (91, ""), (92, None), (93, "the"), (93, "the own3")]
    return docs, items


def test_against_all_scores(spark, prose, monkeypatch):
    """Many small shards in many blocks, ties in plenty; the same for one shard, and with queries in several blocks."""
    docs, items = corpus(prose)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("term", F.lit("x")).repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(0)).withColumn("terms", F.lit(1))
    expected = brute(docs, items)
    assert found(frame.coalesce(1), asked) == expected
    monkeypatch.setattr(search, "QUERY_TERMS", 60)
    assert found(frame, asked) == expected
    assert found(frame, asked, k=3) == brute(docs, items, 3)


def test_odd_rows(spark, odd_rows, prose):
    docs = [*odd_rows, (7, "ONE two-Three ÜBER über"), (8, "one one one"), (None, "one 日本 no"), (9, "x" * 100_000 + " one")]
    items = [(1, "One"), (2, "日本 \U0001f600"), (None, "no id"), (3, "word")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(frame, asked) == brute(docs, items)
    assert found(frame.limit(0), asked) == [] and found(frame, asked.limit(0)) == []


def test_blocks_are_skipped_unread(monkeypatch):
    """With a high score needed, most blocks of a frequent term are passed without being decompressed; postings come back as they went in."""
    r = np.random.default_rng(2)
    n = 20_000
    sizes = r.integers(20, 400, n)
    m = search.length(sizes, n, int(sizes.sum()))
    rare = np.sort(r.choice(n, 30, replace=False))
    doc_of = np.concatenate([np.arange(n), np.repeat(rare, 5)])
    term_of = np.concatenate([np.zeros(n, int), np.repeat(np.ones(30, int), 5)])
    df, at, entries, byte, payload = search.build(term_of, doc_of, m, 2)
    assert df.tolist() == [n, 30]

    def cursor(t, weight):
        return search.Cursor(entries[at[t] : at[t + 1]].tobytes(), payload[byte[t] : byte[t + 1]].tobytes(), weight)

    loads = []
    plain = search.Cursor.load
    monkeypatch.setattr(search.Cursor, "load", lambda self: (loads.append(self.weight), plain(self)))
    got = search.best([cursor(0, 500), cursor(1, 9000)], m, 10, 1)
    scores = {int(d): 500 * search.impact(1, int(m[d])) + 9000 * search.impact(5, int(m[d])) for d in rare}
    assert sorted((-s, -d) for s, d in got) == sorted((-s, d) for d, s in scores.items())[:10]
    assert loads.count(500) < 0.5 * len(entries)
    walk, seen = cursor(1, 1), []
    while walk.doc < 1 << 60:
        seen.append((walk.doc, walk.tf()))
        walk.move(walk.doc + 1)
    assert seen == [(int(d), 5) for d in rare]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.op11_block_max_wand(spark, sf)
    sql = duck.sql(queries.oracle_sql()["op11_block_max_wand"]).select(*got.columns).fetchall()
    assert sql and sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in got.collect())
