import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from ravelin.llm import warc
from ravelin.llm._common import work_path

LONG = "<p>" + "same payload " * 20 + "</p>"
ROWS = [
    (5, "http://a.example.com/x?q=1#f", LONG), (3, "https://B.example.com/y", LONG), (9, None, LONG), (4, "http://a.example.com/x?q=1", "short"), (6, "http://c.net", "short"),
    (7, "no scheme", None), (8, "http://d.org/ü b\n", ""), (3, "https://B.example.com/y", LONG), (None, "http://e.org/", LONG), (10, "http://f.org/", "<p>日本</p>" * 30), (-2, "http://g.org/", "x" * 99),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("key", F.lit("clash"))


@pytest.mark.parametrize("limit", [0, 1000])
def test_round_trip(pages, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)  # both ways of finding shared payloads
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    expected = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        revisit = html == LONG and i != 3
        expected.append((i is None, i or 0, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(expected)


def test_archives_are_plain_warc(spark, pages, tmp_path):
    captures = warc.write_archives(pages, f"file://{tmp_path}")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(ROWS) and data.count(b"WARC-Type: revisit") == 3
    assert captures.count() == len(ROWS) and data.count(b"same payload") == 40


def test_index_over_many_blocks_and_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(warc, "PART_ENTRIES", 50)
    rows = [(i, f"http://h{i % 9}.example.com/{i % 40}", f"page {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/shared"
    captures = warc.write_archives(pages, folder)
    parts = warc.build_index(captures, folder)
    assert len(parts) > 3
    asked = captures.where("key LIKE 'com,example,h3)%'").select("key").union(spark.createDataFrame([("zz",), ("",)], "key string"))
    got = sorted((r.page_id, bytes(r.payload).decode(), r.url) for r in warc.lookup(asked, folder, parts).collect())
    assert got == [(i, h, u) for i, u, h in rows if i % 9 == 3]
    reader = warc.Reader(folder, parts)
    every = [r.key for r in captures.collect()]
    assert all(len(list(reader.find(k.encode()))) == 1 for k in every)


def test_repeated_keys_over_block_ends(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 4)
    pages = spark.createDataFrame([(1, "http://a.org/", "x")] * 15 + [(2, "http://a.org/", "y")], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 16


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert work_path(spark, "x") != work_path(spark, "x")


@pytest.mark.parametrize("nulls", [False, True])
def test_ids_beyond_doubles(spark, tmp_path, nulls):
    """Integers above 2**53 come back as they were, beside null ids too."""
    big = [2**60 + 1, 2**60 + 3, 2**60 + 5, -(2**63), 2**63 - 1]
    rows = [(i, f"http://a.org/{k}", LONG if k < 3 else f"own {k}") for k, i in enumerate(big)] + [(None, "http://n.org/", LONG)] * nulls
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {(big[0], None), (big[1], big[0]), (big[2], big[0]), (big[3], None), (big[4], None)} | ({(None, big[0])} if nulls else set())


def test_record_ids_are_unique(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    ids = [x for x in data.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(ROWS)
