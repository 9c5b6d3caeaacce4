import duckdb
from pyspark.sql import functions as F
from ravelin.llm import url_reputation as u
from ravelin.llm.queries import URL_RULES

URLS = [
    "http://x.example.com/fr/1", "https://WWW.Example.com/en/2?a=/es/", "https://www.example.com/en/3", "https://a.www.example.com/en/", "http://blog.example.com/en/9#x", "http://example.com/enx", "https://m.b.net/es/1", "https://net/fr/",
    "http://b.net/de/", "http://q.co.uk/a", "http://z.q.co.uk", "ftp://host.org?x#y", "no scheme", "", None, "http:///path", "http://com/", "http://notcom/en/", "http://127.0.0.1:80/x", "a://b://c/d", "http://c.net\n/es/",
    "http://10.9.0.1/", "http://a.example.com:8080/x", "http://example.com./y", "http://example.com.:80/", "http://[::1]:80/z", "http://[::1]/", "http://:80/", "http://.../",
]


def frames(spark):
    rows = [(i, x) for i, x in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])] + [(1000 + i, f"http://bad.example.org/{i}") for i in range(60)] + [(2000 + i, f"http://good{i % 3}.example.org/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = [(1000 + i, 0 if i % 10 else 1, 0) for i in range(60)] + [(2000 + i, 1, 0) for i in range(60)] + [(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None)]
    return pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def outcomes(labels):
    return labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def test_against_sql(spark):
    df, labels_df = frames(spark)
    got = u.verdicts(df, outcomes(labels_df), URL_RULES)
    pages, labels = df.select("page_id", "url").toArrow(), labels_df.toArrow()  # noqa: F841  (read by name)
    expected = duckdb.connect().sql(u.oracle(URL_RULES, "SELECT doc_id AS i, (quality = 0 OR toxic = 1)::INT AS bad FROM labels"))
    names = sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(r) for r in expected.select(*names).fetchall())


def test_verdicts(spark):
    pages, labels = frames(spark)
    rows = u.verdicts(pages, outcomes(labels), URL_RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == pages.count()
    rule = lambda i: (got[i].rule, got[i].verdict)
    assert rule(0) == ("com/", "allow") and rule(1) == rule(2) == rule(3) == ("www.example.com/en/", "allow") and rule(4) == ("example.com/en/", "block")
    assert rule(5) == ("com/", "allow") and rule(6) == ("net/es/", "block") and rule(7) == ("net/fr/", "block") and rule(8)[0] is None
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/2") and (got[11].host, got[11].path) == ("host.org", "") and (got[14].host, got[14].path) == ("", "")
    assert {got[1000 + i].verdict for i in range(60)} == {"block"} and {got[2000 + i].verdict for i in range(60)} == {"allow"}
    assert got[1000].bad_rate > 0.5 > got[2000].bad_rate


def test_domains(spark):
    df = spark.createDataFrame([("a.b.example.com",), ("x.foo.co.uk",), ("co.uk",), ("host",), ("",)], "h string")
    got = [(r.d, r.s) for r in df.select(u.domain_of(F.col("h")).alias("d")).withColumn("s", u.suffix_of(F.col("d"))).collect()]
    assert got == [("example.com", "com"), ("foo.co.uk", "co.uk"), ("co.uk", "uk"), ("host", ""), ("", "")]
    more = spark.createDataFrame([("x.shop.com.mx",), ("a.b.blogspot.com",), ("b.or.jp",)], "h string").select(u.domain_of(F.col("h"), ["blogspot.com"]).alias("d"))
    assert [r.d for r in more.collect()] == ["shop.com.mx", "b.blogspot.com", "b.or.jp"]


def test_rules_of_equal_length(spark):
    df = spark.createDataFrame([("http://a.bc/d",)], "url string")
    rules = [("allow", "bc", "/d"), ("block", "bc", "/d"), ("allow", "c", "/d")]
    for order in (rules, rules[::-1]):
        host, path = u.host_and_path(F.col("url"))
        assert df.select(u.rule_of(host, path, order).alias("r")).first().r.verdict == "block"


def test_no_outcomes_and_no_pages(spark):
    pages, labels = frames(spark)
    bare = u.verdicts(pages, outcomes(labels.limit(0)), []).collect()
    assert {r.verdict for r in bare} == {"allow"}
    assert u.verdicts(pages.limit(0), outcomes(labels), URL_RULES).count() == 0


def test_ports_dots_and_addresses(spark):
    """Names with a port or a closing dot belong to their domain; addresses are domains of their own."""
    hosts = {"a.example.com:8080": ("example.com", "com"), "example.com.": ("example.com", "com"), "example.com.:80": ("example.com", "com"), "127.0.0.1:80": ("127.0.0.1", ""), "10.9.0.1": ("10.9.0.1", ""), "[::1]:80": ("[::1]", ""), "x.q.co.uk": ("q.co.uk", "co.uk"), "com": ("com", ""), "": ("", "")}
    df = spark.createDataFrame([(x,) for x in hosts], "host string").select("host", u.domain_of(F.col("host")).alias("d"))
    assert {r.host: (r.d, r.s) for r in df.select("host", "d", u.suffix_of(F.col("d")).alias("s")).collect()} == hosts
