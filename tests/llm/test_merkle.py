import hashlib
import random
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F
from ravelin.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    """(root, path of each node) by plain recursion over levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % arity : i - i % arity + arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0] if nodes else None, paths


def expected(rows, arity=2):
    by = {}
    for r in rows:
        by.setdefault(("" if r[2] is None else "=" + r[2]).encode(), []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    subroots, found = [], []
    for name in sorted(by):
        held = sorted(by[name], key=lambda x: x[:3])
        root, paths = tree([x[2] for x in held], arity)
        subroots.append(root)
        found.append([(x[3], x[2], root, p) for x, p in zip(held, paths, strict=True)])
    top, above = tree(subroots, arity)
    out = []
    for group, up in zip(found, above, strict=True):
        for row, leaf, sub, path in group:
            path = path + up
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = h(*map(field, (*row[:3], row[3] + 1, row[4]))) if tampered else leaf
            for before, after in path:
                node = h(before, node, after)
            out.append((row[0], leaf, sub, top, h(*[b + a for b, a in path]), node, node == top))
    return sorted(map(repr, out))


def audited(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    grown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.audit(merkle.manifest(docs, {"n_chars": grown}, **kw))
    return sorted(repr(tuple(r)) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize(("arity", "depth"), [(2, 8), (2, 1), (3, 2)])
def test_against_plain_recursion(spark, arity, depth):
    r = random.Random(arity * 10 + depth)
    rows = [(k, r.choice(["a", "b", None]), r.choice(["en", "de", "zü", "en", "en", None]), r.choice([None, 5, 70]), r.choice(["text ü", "", None, "x" * 300])) for k in range(90)]
    r.shuffle(rows)
    assert audited(spark, rows, arity=arity, depth=depth) == expected(rows, arity)


def test_odd_tables(spark, odd_rows):
    """Null ids, repeated rows (one is half of all), lone groups, an empty table, and columns of clashing names."""
    rows = [(i, "s", "en" if k % 2 else None, len(t or ""), t) for k, (i, t) in enumerate(odd_rows)] + [(7, "s", "fr", 1, "again")] * 40 + [(8, None, "it", None, None)]
    assert audited(spark, rows, depth=2) == expected(rows)
    lone = [(1, "s", "en", 3, "one")]
    assert audited(spark, lone) == expected(lone)
    assert audited(spark, []) == []
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "index", "grp", "digest", "path", "now", "row"):
        docs = docs.withColumn(name, F.lit(1))
    assert merkle.manifest(docs).count() == len(rows)
    with pytest.raises(ValueError, match="arity"):
        merkle.manifest(docs, arity=1)


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, str(k)) for k in range(600)], SCHEMA)
    found = merkle.audit(merkle.manifest(docs))
    assert found.where("verified").count() == 600 and found.select("root").distinct().count() == 1


def test_partial_parents_merge_in_any_order():
    """Nodes that arrive in parts, in any order, close the same parents."""
    nodes = [h(str(k)) for k in range(13)]
    root, paths = tree(nodes, 2)
    r = random.Random(1)
    for _ in range(30):
        parts = [None] * 4
        for k in r.sample(range(13), 13):
            at = r.randrange(4)
            parts[at] = (parts[at] or merkle.Parents(13, 2, 8)).add((k, nodes[k], None))
        whole = None
        for p in filter(None, parts):
            whole = p if whole is None else whole.merge(p)
        assert whole.top == root and not whole.open and [whole.path(k) for k in range(13)] == paths


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_merkle(spark, sf)
    columns = sorted(got.columns)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = duck.sql(queries.oracle_sql()["op13_merkle"]).select(*columns).fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    shares = [r.verified for r in got.select("verified").collect()]
    assert 0.05 < shares.count(False) / len(shares) < 0.3
