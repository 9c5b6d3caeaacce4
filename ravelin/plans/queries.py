"""The registry: one query per operator over the whole test tables, with its DuckDB SQL.

Supports and splits are rules over the whole data (a share of all baskets, each
user's latest rating), never subsets chosen by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.minhash import BANDS, HASHES
from ..operators import explore, itemsets, layout, recommend, similarity
from ..sources import files
from ..sources import star_schema as tables
from ..sources.work import work_path, written

YEAR = tables.YEAR
#: A set is frequent in this share of the order baskets, or of the part-type baskets.
SHARE, TYPE_SHARE = 0.004, 0.033
LARGER_THAN = 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REVIEWS = """reviews AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS business_id,
    strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(ceil(l_quantity / 10) AS DOUBLE) AS stars, l_orderkey AS order_id, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BUSINESSES = "businesses AS (SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_brand AS city FROM part)"


# -- exploration


@query(f"WITH {REVIEWS} SELECT count(*) AS n_review, count(*) FILTER (WHERE substr(date, 1, 4) = '{YEAR}') AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business FROM reviews")
def review_summary(spark, d):
    return explore.review_summary(tables.reviews(spark, d), YEAR)


@query(f"WITH {REVIEWS} SELECT count(*) AS n_review, count(*) FILTER (WHERE substr(date, 1, 4) = '{YEAR}') AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business FROM reviews")
def review_summary_dense(spark, d):
    return explore.review_summary_dense(tables.reviews(spark, d), YEAR)


@query(f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews WHERE substr(date, 1, 4) = '{YEAR}'")
def reviews_in_year(spark, d):
    return explore.reviews_in_year(tables.reviews(spark, d), YEAR).agg(F.count("*").alias("n"))


@query(f"WITH {REVIEWS} SELECT DISTINCT user_id FROM reviews")
def distinct_users(spark, d):
    return tables.reviews(spark, d).select("user_id").distinct()


@query(f"WITH {REVIEWS} SELECT DISTINCT business_id FROM reviews")
def distinct_businesses(spark, d):
    return tables.reviews(spark, d).select("business_id").distinct()


@query(f"WITH {REVIEWS} SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top10_users(spark, d):
    return explore.top(tables.reviews(spark, d), "user_id")


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id ORDER BY n DESC, business_id LIMIT 10")
def top10_businesses(spark, d):
    return explore.top(tables.reviews(spark, d), "business_id")


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id")
def business_counts(spark, d):
    return explore.counts(tables.reviews(spark, d), "business_id")


#: crc32 of a text of ASCII characters, bit by bit: -1 stands for a shift.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(business_id, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""
PARTS = 8


@query(f"""WITH {REVIEWS}, ids AS (SELECT DISTINCT business_id FROM reviews), placed AS (SELECT ({CRC32} % {PARTS})::INT AS part FROM ids)
  SELECT part::INT AS part, count(placed.part) AS n_items FROM range({PARTS}) t(part) LEFT JOIN placed USING (part) GROUP BY ALL""")
def partition_profile(spark, d):
    """Rows of each partition of the ranking dealt by its key."""
    counts = explore.counts(tables.reviews(spark, d), "business_id")
    return layout.partition_profile(counts, PARTS).where("layout = 'hash'").select("part", "n_items")


@query(f"WITH {REVIEWS} SELECT {PARTS}::INT AS parts, count(DISTINCT business_id) AS n_items, 0::BIGINT AS overlaps FROM reviews")
def partition_ranges(spark, d):
    """Where ranges begin is Spark's own; all hold rows, and none begins before the one ahead of it ends."""
    counts = explore.counts(tables.reviews(spark, d), "business_id")
    return layout.range_order(layout.ranged(counts, PARTS), PARTS)


@query(f"""WITH {REVIEWS}, u AS (SELECT user_id AS id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, id LIMIT 10), b AS (SELECT business_id AS id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, id LIMIT 10),
  top AS (SELECT (SELECT string_agg(id || ':' || n, ',' ORDER BY n DESC, id) FROM u) AS top10_user, (SELECT string_agg(id || ':' || n, ',' ORDER BY n DESC, id) FROM b) AS top10_business)
  SELECT count(*) AS n_review, count(*) FILTER (WHERE substr(date, 1, 4) = '{YEAR}') AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business, any_value(top10_user) AS top10_user, any_value(top10_business) AS top10_business FROM reviews, top""")
def summary_document(spark, d):
    """The report as its JSON document, parsed again."""
    text = files.document(explore.report(tables.reviews(spark, d), YEAR))
    lists = "array<array<string>>"
    got = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", f"n_review long, n_review_{YEAR} long, n_user long, n_business long, top10_user {lists}, top10_business {lists}").alias("x")).select("x.*")
    shown = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ":")), ",").alias(c)
    return got.select("n_review", F.col(f"n_review_{YEAR}").alias("n_review_year"), "n_user", "n_business", shown("top10_user"), shown("top10_business"))


@query(f"WITH {REVIEWS}, {BUSINESSES} SELECT business_id, city, stars FROM businesses LEFT JOIN (SELECT business_id, stars FROM reviews) USING (business_id)")
def business_reviews_left(spark, d):
    return explore.business_reviews(tables.businesses(spark, d), tables.reviews(spark, d))


CITY = f"WITH {REVIEWS}, {BUSINESSES}, cities AS (SELECT city, avg(stars) AS exact, round(avg(stars), 1) AS stars FROM businesses JOIN reviews USING (business_id) WHERE stars IS NOT NULL GROUP BY city)"


def _placed(cities: DataFrame, *order) -> DataFrame:
    """The order as a column, for comparison."""
    return cities.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(f"{CITY} SELECT city, stars, row_number() OVER (ORDER BY stars DESC, lower(city), city) AS place FROM cities")
def city_stars(spark, d):
    found = explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d))
    return _placed(found, F.desc("stars"), F.lower("city"), "city")


@query(f"{CITY} SELECT city, stars, row_number() OVER (ORDER BY exact DESC, lower(city), city) AS place FROM cities")
def city_stars_exact_order(spark, d):
    """The place is that of the row in the operator's own order."""
    found = explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d), order_by_exact=True)
    return _placed(found.withColumn("at", F.monotonically_increasing_id()), "at").drop("at")


@query(f"{CITY} SELECT city, floor(exact * 10 + 0.5) / 10 AS stars FROM cities")
def city_stars_half_up(spark, d):
    return explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d), rounding="half_up")


@query(f"{CITY} SELECT city, stars FROM cities ORDER BY stars DESC, lower(city), city LIMIT 10")
def city_stars_top10(spark, d):
    return explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d)).limit(10)


# -- itemsets

BASKETS = "baskets AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
TYPES = "baskets AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
LEAST = f"least AS (SELECT CAST(ceil({SHARE} * count(DISTINCT basket)) AS BIGINT) AS s FROM baskets)"


def _support(rows: DataFrame, share: float) -> int:
    n = rows.agg(F.countDistinct("basket")).first()[0]
    return max(1, math.ceil(share * n))


def _level(rows: DataFrame, k: int, frequent: bool, share: float = SHARE) -> DataFrame:
    found = itemsets.levels(rows, _support(rows, share), k)[int(frequent)].where(F.col("k") == k)
    return found.select(F.array_join("items", ",").alias("items"), *(["support"] if frequent else []))


def _sets(k: int) -> str:
    """Counted k-sets as CTEs s1 .. sk, from the baskets that hold them."""
    out = ["s1 AS (SELECT item AS a, count(*) AS n FROM baskets GROUP BY item)"]
    if k >= 2:
        out.append("s2 AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL)")
    if k >= 3:
        out.append("s3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS n FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item JOIN baskets z ON x.basket = z.basket AND y.item < z.item GROUP BY ALL)")
    return ", ".join(out)


#: Shares that drop about half of the part sizes, and half of their pairs.
SIZE_SHARE, SIZE_PAIR_SHARE = 0.0775, 0.0047
SIZES = "baskets AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS basket, lpad(CAST(p_size AS VARCHAR), 2, '0') AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
FREQUENT_2 = "l1 AS (SELECT a FROM s1, least WHERE n >= s), l2 AS (SELECT a, b FROM s2, least WHERE n >= s)"


def _brands(spark, d, larger_than=None) -> DataFrame:
    return itemsets.baskets(tables.order_brands(spark, d), 1, larger_than)


@query(f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM baskets GROUP BY basket")
def baskets_by_user(spark, d):
    return itemsets.basket_strings(_brands(spark, d))


@query(f"WITH {TYPES} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM baskets GROUP BY basket")
def baskets_by_business(spark, d):
    return itemsets.basket_strings(itemsets.baskets(tables.type_orders(spark, d), 2))


@query(f"WITH {BASKETS} SELECT item, count(*) AS support FROM baskets GROUP BY item")
def item_support(spark, d):
    return itemsets.item_support(_brands(spark, d))


@query(f"WITH {BASKETS} SELECT DISTINCT item AS items FROM baskets")
def candidates_k1(spark, d):
    return _level(_brands(spark, d), 1, False)


@query(f"WITH {BASKETS}, {LEAST}, {_sets(2)}, {FREQUENT_2} SELECT x.a || ',' || y.a AS items FROM l1 x JOIN l1 y ON x.a < y.a")
def candidates_k2(spark, d):
    return _level(_brands(spark, d), 2, False)


@query(f"WITH {BASKETS}, {LEAST}, {_sets(2)}, {FREQUENT_2} SELECT x.a || ',' || x.b || ',' || y.b AS items FROM l2 x JOIN l2 y ON x.a = y.a AND x.b < y.b JOIN l2 z ON z.a = x.b AND z.b = y.b")
def candidates_k3(spark, d):
    return _level(_brands(spark, d), 3, False)


@query(f"WITH {BASKETS}, {LEAST}, {_sets(1)} SELECT a AS items, n AS support FROM s1, least WHERE n >= s")
def frequent_k1(spark, d):
    return _level(_brands(spark, d), 1, True)


@query(f"WITH {BASKETS}, {LEAST}, {_sets(2)} SELECT a || ',' || b AS items, n AS support FROM s2, least WHERE n >= s")
def frequent_k2(spark, d):
    return _level(_brands(spark, d), 2, True)


THREE = f"{_sets(3)}, found AS (SELECT 1 AS k, a AS items, n FROM s1 UNION ALL SELECT 2, a || ',' || b, n FROM s2 UNION ALL SELECT 3, a || ',' || b || ',' || c, n FROM s3)"


@query(f"WITH {BASKETS}, {LEAST}, {_sets(3)} SELECT a || ',' || b || ',' || c AS items, n AS support FROM s3, least WHERE n >= s")
def frequent_k3(spark, d):
    return _level(_brands(spark, d), 3, True)


FOUR_FIVE = """s4 AS (SELECT w.item AS a, x.item AS b, y.item AS c, z.item AS d, w.basket, count(*) OVER (PARTITION BY w.item, x.item, y.item, z.item) AS n FROM baskets w JOIN baskets x ON w.basket = x.basket AND w.item < x.item JOIN baskets y ON w.basket = y.basket AND x.item < y.item JOIN baskets z ON w.basket = z.basket AND y.item < z.item),
  s5 AS (SELECT a, b, c, d, item AS e, count(*) AS n FROM s4 JOIN baskets USING (basket) WHERE d < item GROUP BY ALL)"""


@query(f"""WITH raw AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
  baskets AS (SELECT * FROM raw WHERE basket IN (SELECT basket FROM raw GROUP BY basket HAVING count(*) > {LARGER_THAN})), {LEAST}, {THREE}, {FOUR_FIVE},
  larger AS (SELECT DISTINCT 4 AS k, concat_ws(',', a, b, c, d) AS items, n FROM s4 UNION ALL SELECT 5, concat_ws(',', a, b, c, d, e), n FROM s5)
  SELECT k, items, n AS support FROM (SELECT * FROM found UNION ALL SELECT * FROM larger), least WHERE n >= s""")
def frequent_filtered(spark, d):
    rows = _brands(spark, d, LARGER_THAN)
    found = itemsets.levels(rows, _support(rows, SHARE))[1]
    return found.select("k", F.array_join("items", ",").alias("items"), "support")


def _least(share: float) -> str:
    return f"least AS (SELECT CAST(ceil({share} * count(DISTINCT basket)) AS BIGINT) AS s FROM baskets)"


def _sizes(spark, d) -> DataFrame:
    return itemsets.baskets(tables.order_sizes(spark, d), 1)


@query(f"WITH {SIZES}, {_least(SIZE_SHARE)}, {_sets(1)} SELECT a AS items, n AS support FROM s1, least WHERE n >= s")
def sizes_frequent_k1(spark, d):
    return _level(_sizes(spark, d), 1, True, SIZE_SHARE)


@query(f"WITH {SIZES}, {_least(SIZE_SHARE)}, {_sets(1)}, l1 AS (SELECT a FROM s1, least WHERE n >= s) SELECT x.a || ',' || y.a AS items FROM l1 x JOIN l1 y ON x.a < y.a")
def sizes_candidates_k2(spark, d):
    return _level(_sizes(spark, d), 2, False, SIZE_SHARE)


@query(f"WITH {SIZES}, {_least(SIZE_PAIR_SHARE)}, {_sets(2)} SELECT a || ',' || b AS items, n AS support FROM s2, least WHERE n >= s")
def sizes_frequent_k2(spark, d):
    return _level(_sizes(spark, d), 2, True, SIZE_PAIR_SHARE)


@query(f"WITH {SIZES}, {_least(SIZE_PAIR_SHARE)}, {_sets(2)}, {FREQUENT_2} SELECT x.a || ',' || x.b || ',' || y.b AS items FROM l2 x JOIN l2 y ON x.a = y.a AND x.b < y.b JOIN l2 z ON z.a = x.b AND z.b = y.b")
def sizes_candidates_k3(spark, d):
    return _level(_sizes(spark, d), 3, False, SIZE_PAIR_SHARE)


@query(f"WITH {SIZES}, {_least(SIZE_SHARE)}, {_sets(1)}, shown AS (SELECT a, '(' || chr(39) || a || chr(39) || ')' AS t, n >= s AS f FROM s1, least) SELECT line, text FROM (SELECT 1 AS line, 'Candidates:' AS text UNION ALL SELECT 2, (SELECT string_agg(t, ',' ORDER BY a) FROM shown) UNION ALL SELECT 3, 'Frequent Itemsets:' UNION ALL SELECT 4, (SELECT string_agg(t, ',' ORDER BY a) FROM shown WHERE f))")
def itemset_report_k1(spark, d):
    """The lines of the report over sets of one, blank ones left out."""
    rows = _sizes(spark, d)
    text = files.itemset_report(*itemsets.levels(rows, _support(rows, SIZE_SHARE), 1))
    return spark.createDataFrame(list(enumerate(filter(None, text.split("\n")), 1)), "line int, text string")


def _all_levels_sql(frequent: bool) -> str:
    """All six levels of the part-type baskets by brute force over subsets of the six types."""
    return f"""WITH RECURSIVE {TYPES}, least AS (SELECT CAST(ceil({TYPE_SHARE} * count(DISTINCT basket)) AS BIGINT) AS s FROM baskets),
    items AS (SELECT DISTINCT item FROM baskets),
    sets(k, items) AS (SELECT 1, [item] FROM items UNION ALL SELECT k + 1, list_append(sets.items, i.item) FROM sets JOIN items i ON i.item > sets.items[k]),
    lists AS (SELECT basket, list(item) AS held FROM baskets GROUP BY basket),
    counted AS (SELECT k, items, (SELECT count(*) FROM lists WHERE list_has_all(held, items)) AS n FROM sets)
    SELECT k, array_to_string(items, ',') AS items, n AS support FROM counted, least WHERE n >= s"""


@query(_all_levels_sql(True))
def frequent_all_levels(spark, d):
    rows = itemsets.baskets(tables.type_orders(spark, d), 2)
    found = itemsets.levels(rows, _support(rows, TYPE_SHARE))[1]
    return found.select("k", F.array_join("items", ",").alias("items"), "support")


def _report_sql() -> str:
    """The lines of the report over all levels of the part-type baskets: candidates are the sets all of whose parts are frequent."""
    counted = _all_levels_sql(True).split("SELECT k, array_to_string")[0]
    return f"""{counted}, found AS (SELECT k, items, n >= s AS f FROM counted, least),
    wanted AS (SELECT k, items, f, k = 1 OR NOT EXISTS (SELECT 1 FROM (SELECT unnest(items) AS i) WHERE list_filter(items, lambda x: x <> i) NOT IN (SELECT items FROM found WHERE f)) AS c FROM found),
    shown AS (SELECT k, items, f, '(' || array_to_string(list_transform(items, lambda x: chr(39) || x || chr(39)), ', ') || ')' AS t FROM wanted WHERE c),
    pieces AS (SELECT 1 AS section, 0 AS k, 'Candidates:' AS text UNION ALL SELECT 1, k, string_agg(t, ',' ORDER BY items) FROM shown GROUP BY k
      UNION ALL SELECT 2, 0, 'Frequent Itemsets:' UNION ALL SELECT 2, k, string_agg(t, ',' ORDER BY items) FROM shown WHERE f GROUP BY k)
    SELECT row_number() OVER (ORDER BY section, k)::INT AS line, text FROM pieces"""


@query(_report_sql())
def itemset_report(spark, d):
    """The lines of the written report over all levels, blank ones left out."""
    rows = itemsets.baskets(tables.type_orders(spark, d), 2)
    path = work_path(spark, "report").removeprefix("file://")
    files.write_itemset_report(*itemsets.levels(rows, _support(rows, TYPE_SHARE)), path)
    lines = spark.read.text(path).where("value != ''").withColumn("at", F.monotonically_increasing_id())
    return lines.select(F.row_number().over(Window.orderBy("at")).alias("line"), F.col("value").alias("text"))  # two lines a level


@query(_all_levels_sql(True))
def frequent_son(spark, d):
    """The same sets in two passes."""
    rows = itemsets.baskets(tables.type_orders(spark, d), 2)
    return itemsets.son(rows, _support(rows, TYPE_SHARE)).select("k", F.array_join("items", ",").alias("items"), "support")


@query(f"WITH {BASKETS}, {LEAST}, {THREE.replace('found AS', 'three AS')}, s4 AS (SELECT w.item || ',' || x.item || ',' || y.item || ',' || z.item AS items, count(*) AS n FROM baskets w JOIN baskets x ON w.basket = x.basket AND w.item < x.item JOIN baskets y ON w.basket = y.basket AND x.item < y.item JOIN baskets z ON w.basket = z.basket AND y.item < z.item GROUP BY ALL), found AS (SELECT * FROM three UNION ALL SELECT 4, items, n FROM s4) SELECT k, items, n AS support FROM found, least WHERE n >= s")
def frequent_fpgrowth(spark, d):
    rows = _brands(spark, d)
    return itemsets.frequent_by_fpgrowth(rows, _support(rows, SHARE)).select("k", F.array_join("items", ",").alias("items"), "support")


# -- similarity

MEMBERS = "members AS (SELECT DISTINCT p_brand AS business_id, CAST(o_custkey AS VARCHAR) AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
USERS = "users AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM members))"
SIGNATURES = "signatures AS (SELECT business_id, " + ", ".join(f"min((({a} * idx + {b}) % {p}) % m) AS h{i}" for i, (a, b, p) in enumerate(HASHES)) + " FROM members JOIN users USING (user_id), (SELECT count(*) AS m FROM users) GROUP BY business_id)"
BUCKETS = "buckets AS (" + " UNION ALL ".join(f"SELECT {i} AS band, CAST(h{i} AS VARCHAR) AS band_key, business_id FROM signatures" for i in range(BANDS)) + ")"
CANDIDATES = "candidates AS (SELECT DISTINCT x.business_id AS business_id_1, y.business_id AS business_id_2 FROM buckets x JOIN buckets y ON x.band = y.band AND x.band_key = y.band_key AND x.business_id < y.business_id)"
LSH = f"WITH {MEMBERS}, {USERS}, {SIGNATURES}, {BUCKETS}, {CANDIDATES}"


@query(f"WITH {MEMBERS}, {USERS} SELECT user_id, CAST(idx AS BIGINT) AS idx FROM users")
def user_dictionary(spark, d):
    return similarity.dictionary(similarity.members(tables.brand_customers(spark, d)), "user_id")


@query(f"WITH {MEMBERS}, {USERS}, {SIGNATURES} SELECT business_id, concat_ws(',', {', '.join(f'h{i}' for i in range(len(HASHES)))}) AS signature FROM signatures")
def minhash_signature(spark, d):
    found = similarity.signatures(tables.brand_customers(spark, d))
    return found.select("business_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(f"{LSH} SELECT band, band_key, string_agg(business_id, ',' ORDER BY business_id) AS businesses FROM buckets GROUP BY band, band_key HAVING count(*) > 1")
def lsh_buckets(spark, d):
    found = similarity.buckets(similarity.signatures(tables.brand_customers(spark, d)))
    held = found.groupBy("band", F.array_join(F.col("band_key").cast("array<string>"), ",").alias("band_key")).agg(F.array_sort(F.collect_list("business_id")).alias("b"))
    return held.where(F.size("b") > 1).select("band", "band_key", F.array_join("b", ",").alias("businesses"))


@query(f"{LSH} SELECT business_id_1, business_id_2 FROM candidates")
def lsh_candidate_pairs(spark, d):
    return similarity.candidates(similarity.buckets(similarity.signatures(tables.brand_customers(spark, d))))


@query(f"""{LSH}, sizes AS (SELECT business_id, count(*) AS n FROM members GROUP BY business_id),
  common AS (SELECT business_id_1, business_id_2, count(*) AS c FROM candidates JOIN members x ON x.business_id = business_id_1 JOIN members y ON y.business_id = business_id_2 AND x.user_id = y.user_id GROUP BY ALL)
  SELECT business_id_1, business_id_2, round(c / (s.n + t.n - c), 6) AS similarity FROM common JOIN sizes s ON s.business_id = business_id_1 JOIN sizes t ON t.business_id = business_id_2 WHERE c / (s.n + t.n - c) >= 0.5""")
def similar_pairs(spark, d):
    return similarity.similar(tables.brand_customers(spark, d)).withColumn("similarity", F.round("similarity", 6))


#: Bands of two rows over the twelve hashes.
PAIR_BANDS, PAIR_ROWS = 6, 2
WORDS = "words AS (SELECT CAST(doc_id AS VARCHAR) AS business_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS w FROM documents), members AS (SELECT DISTINCT business_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS user_id FROM words)"
PAIR_BUCKETS = "buckets AS (" + " UNION ALL ".join(f"SELECT {i} AS band, CAST(h{2 * i} AS VARCHAR) || ',' || CAST(h{2 * i + 1} AS VARCHAR) AS band_key, business_id FROM signatures" for i in range(PAIR_BANDS)) + ")"
DOC_LSH = f"WITH {WORDS}, {USERS}, {SIGNATURES}, {PAIR_BUCKETS}, {CANDIDATES}"


@query(f"{DOC_LSH} SELECT business_id_1, business_id_2 FROM candidates")
def document_candidate_pairs(spark, d):
    """Documents as sets of word pairs: most pairs of documents share no band."""
    return similarity.candidates(similarity.buckets(similarity.signatures(tables.document_pairs(spark, d)), PAIR_BANDS, PAIR_ROWS))


@query(f"""{DOC_LSH}, sizes AS (SELECT business_id, count(*) AS n FROM members GROUP BY business_id),
  common AS (SELECT business_id_1, business_id_2, count(*) AS c FROM candidates JOIN members x ON x.business_id = business_id_1 JOIN members y ON y.business_id = business_id_2 AND x.user_id = y.user_id GROUP BY ALL)
  SELECT business_id_1, business_id_2, round(c / (s.n + t.n - c), 6) AS similarity FROM common JOIN sizes s ON s.business_id = business_id_1 JOIN sizes t ON t.business_id = business_id_2 WHERE c / (s.n + t.n - c) >= 0.9""")
def similar_documents(spark, d):
    """At a threshold that drops a part of the candidates."""
    return similarity.similar(tables.document_pairs(spark, d), 0.9, PAIR_BANDS, PAIR_ROWS).withColumn("similarity", F.round("similarity", 6))


# -- readers and writers: a test table is written in the format and read back by the package's own reader


def _read_back(spark, df: DataFrame, kind: str, read) -> DataFrame:
    path = work_path(spark, kind)
    (df.write.json(path) if kind == "json" else df.write.csv(path, header=True))
    return read(spark, path)


@query(f"WITH {REVIEWS} SELECT user_id, business_id, date FROM reviews")
def read_reviews_json(spark, d):
    return _read_back(spark, tables.reviews(spark, d), "json", files.reviews)


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id")
def read_review_businesses_json(spark, d):
    return explore.counts(_read_back(spark, tables.reviews(spark, d), "json", files.review_businesses), "business_id")


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id")
def read_nested_json(spark, d):
    """The first business of each line, at the top, in a list, or deep beside a text that looks like it."""
    rows = tables.reviews(spark, d)
    own, other = F.col("business_id"), F.lit("another").alias("business_id")
    shapes = [
        F.to_json(F.struct(own, F.struct(other).alias("more"))),
        F.to_json(F.struct(F.struct("stars", F.array(F.struct(F.lit("business_id").alias("x"), own)).alias("at")).alias("review"), other)),
        F.to_json(F.struct(F.lit('say "business_id": "no"').alias("text"), F.struct(F.struct(own).alias("y")).alias("z"))),
    ]
    path = work_path(spark, "nested")
    rows.select(F.element_at(F.array(*shapes), (F.col("line") % 3 + 1).cast("int")).alias("value")).write.text(path)
    return explore.counts(files.first_at_any_depth(spark, path), "business_id")


@query(f"WITH {REVIEWS} SELECT business_id, CASE WHEN stars > 1 THEN stars END AS stars FROM reviews")
def read_review_stars_json(spark, d):
    """Stars may be missing."""
    some = tables.reviews(spark, d).withColumn("stars", F.when(F.col("stars") > 1, F.col("stars")))
    return _read_back(spark, some, "json", files.review_stars)


@query(f"WITH {BUSINESSES} SELECT business_id, city FROM businesses")
def read_businesses_json(spark, d):
    return _read_back(spark, tables.businesses(spark, d), "json", files.businesses)


@query(f"WITH {REVIEWS} SELECT user_id, business_id FROM reviews")
def read_pairs_csv(spark, d):
    return _read_back(spark, tables.reviews(spark, d), "csv", files.pairs)


@query(f"WITH {REVIEWS} SELECT user_id, business_id, stars FROM reviews")
def read_ratings_csv(spark, d):
    return _read_back(spark, tables.reviews(spark, d).select("user_id", "business_id", "stars"), "csv", files.ratings)


@query(f"WITH {REVIEWS} SELECT 2 AS n_partition, count(*) AS n FROM reviews")
def spread_over_two(spark, d):
    dealt = files.spread(tables.reviews(spark, d), 2).select(F.spark_partition_id().alias("p"))
    return dealt.agg(F.countDistinct("p").cast("int").alias("n_partition"), F.count("*").alias("n"))


@query(f"{CITY} SELECT city, stars, row_number() OVER (ORDER BY stars DESC, lower(city), city) AS place FROM cities")
def write_city_csv(spark, d):
    """One headered CSV file in the operator's order; the place is that of the line."""
    path = work_path(spark, "cities")
    files.write_city_stars(explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d)), path)
    got = spark.read.schema("city string, stars double").csv(path, header=True).withColumn("at", F.monotonically_increasing_id())
    return _placed(got, "at").drop("at")


@query(f"{CITY} SELECT city || ',' || stars AS value FROM cities")
def write_city_text(spark, d):
    path = work_path(spark, "cities")
    files.write_city_stars_text(explore.city_stars(tables.businesses(spark, d), tables.reviews(spark, d)), path)
    return spark.read.text(path)


# -- rating prediction

RATED = f"{REVIEWS}, latest AS (SELECT user_id, business_id AS item_id, stars, row_number() OVER (PARTITION BY user_id, business_id ORDER BY order_id DESC, line DESC, stars DESC) AS r FROM reviews), ratings AS (SELECT user_id, item_id, stars FROM latest WHERE r = 1)"
#: The test rows are each user's last line items (all of the newest order); all others are training rows.
SPLIT = """newest AS (SELECT user_id, max(order_id) AS o FROM reviews GROUP BY user_id),
  parts AS (SELECT r.user_id, business_id AS item_id, stars, order_id, line, order_id = o AS held FROM reviews r JOIN newest n ON r.user_id = n.user_id),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY held, user_id, item_id ORDER BY order_id DESC, line DESC, stars DESC) AS r FROM parts),
  train AS (SELECT user_id, item_id, stars FROM firsts WHERE r = 1 AND NOT held), test AS (SELECT user_id, item_id, stars FROM firsts WHERE r = 1 AND held)"""


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = tables.rated(spark, d)
    newest = rows.groupBy("user_id").agg(F.max("order_id").alias("newest"))
    marked = written(rows.join(newest, "user_id"), "marked")
    part = lambda cond: written(recommend.last_ratings(marked.where(cond), ["order_id", "line"]), "ratings")
    return part("order_id < newest"), part("order_id = newest")


@query(f"WITH {RATED} SELECT user_id, item_id, stars FROM ratings")
def ratings_last(spark, d):
    return recommend.last_ratings(tables.rated(spark, d), ["order_id", "line"])


@query(f"WITH {RATED}, s AS (SELECT user_id, sum(stars) AS t, count(*) AS n FROM ratings GROUP BY user_id) SELECT user_id, item_id, round(coalesce((t - stars) / nullif(n - 1, 0), 0), 6) AS others FROM ratings JOIN s USING (user_id)")
def leave_one_out_avg(spark, d):
    found = recommend.leave_one_out_means(recommend.last_ratings(tables.rated(spark, d), ["order_id", "line"]))
    return found.withColumn("others", F.round("others", 6))


def _weights_sql(who: str, what: str) -> str:
    """Pearson of the wanted pairs (view wanted: x, y) over the training ratings, from sums scaled by n, which are exact for integer stars."""
    return f"""common AS (SELECT x, y, a.stars AS rx, b.stars AS ry FROM wanted JOIN train a ON a.{who} = x JOIN train b ON b.{who} = y AND a.{what} = b.{what}),
  sums AS (SELECT x, y, count(*) AS n, count(*) * sum(rx * ry) - sum(rx) * sum(ry) AS c, count(*) * sum(rx * rx) - sum(rx) * sum(rx) AS vx, count(*) * sum(ry * ry) - sum(ry) * sum(ry) AS vy FROM common GROUP BY x, y),
  weights AS (SELECT x, y, n, CASE WHEN n < 2 OR vx <= 0 OR vy <= 0 THEN 0 ELSE round(c / sqrt(vx * vy), 12) END AS w FROM sums)"""


USER_NEAR = "near AS (SELECT t.user_id AS x, t.item_id, r.user_id AS y, r.stars AS ry FROM test t JOIN train r ON r.item_id = t.item_id), wanted AS (SELECT DISTINCT x, y FROM near)"
ITEM_NEAR = "near AS (SELECT t.user_id, t.item_id AS x, r.item_id AS y, r.stars AS ry FROM test t JOIN train r ON r.user_id = t.user_id WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = t.user_id AND s.item_id = t.item_id)), wanted AS (SELECT DISTINCT x, y FROM near)"
USER_CF = f"""WITH {REVIEWS}, {SPLIT}, {USER_NEAR}, {_weights_sql("user_id", "item_id")},
  ranked AS (SELECT near.*, coalesce(w, 0) AS w, row_number() OVER (PARTITION BY near.x, item_id ORDER BY round(coalesce(w, 0), 9) DESC, near.y) AS place FROM near LEFT JOIN weights v ON v.x = near.x AND v.y = near.y),
  totals AS (SELECT user_id, sum(stars) AS t, count(*) AS n FROM train GROUP BY user_id),
  moved AS (SELECT x AS user_id, item_id, sum((ry - coalesce((t - ry) / nullif(n - 1, 0), 0)) * w) AS up, sum(abs(w)) AS down FROM ranked JOIN totals ON user_id = y WHERE place <= 10 GROUP BY ALL),
  predicted AS (SELECT t.user_id, t.item_id, t.stars,
    CASE WHEN u.t IS NULL OR NOT EXISTS (SELECT 1 FROM train q WHERE q.item_id = t.item_id) THEN 0
      ELSE least(5, greatest(0, coalesce((u.t - coalesce(o.stars, 0)) / nullif(u.n - (o.stars IS NOT NULL)::INT, 0), 0) + coalesce(up / nullif(down, 0), 0))) END AS prediction
    FROM test t LEFT JOIN totals u ON u.user_id = t.user_id LEFT JOIN train o ON o.user_id = t.user_id AND o.item_id = t.item_id LEFT JOIN moved m ON m.user_id = t.user_id AND m.item_id = t.item_id)"""
ITEM_CF = f"""WITH {REVIEWS}, {SPLIT}, {ITEM_NEAR}, {_weights_sql("item_id", "user_id")},
  ranked AS (SELECT near.*, coalesce(w, 0) AS w, row_number() OVER (PARTITION BY user_id, near.x ORDER BY round(coalesce(w, 0), 9) DESC, near.y) AS place FROM near LEFT JOIN weights v ON v.x = near.x AND v.y = near.y),
  mixed AS (SELECT user_id, x AS item_id, sum(ry * w) AS up, sum(abs(w)) AS down FROM ranked WHERE place <= 10 GROUP BY ALL),
  means AS (SELECT item_id, avg(stars) AS m FROM train GROUP BY item_id),
  predicted AS (SELECT t.user_id, t.item_id, t.stars,
    CASE WHEN o.stars IS NOT NULL THEN o.stars WHEN NOT EXISTS (SELECT 1 FROM train q WHERE q.user_id = t.user_id) THEN 0
      ELSE least(5, greatest(0, coalesce(up / nullif(down, 0), a.m, 0))) END AS prediction
    FROM test t LEFT JOIN train o ON o.user_id = t.user_id AND o.item_id = t.item_id LEFT JOIN means a ON a.item_id = t.item_id LEFT JOIN mixed m ON m.user_id = t.user_id AND m.item_id = t.item_id)"""


def _correlated(train: DataFrame, who: str, what: str) -> DataFrame:
    return recommend.all_correlations(train, who, what).select("x", "y", "n", (F.round("w", 6) + 0.0).alias("w"))


def _pearson(spark, d, who: str, what: str) -> DataFrame:
    """Correlations of all pairs that have a rating in common, each once."""
    train = recommend.last_ratings(tables.rated(spark, d), ["order_id", "line"])
    return _correlated(train, who, what)


def _pearson_sql(who: str, what: str) -> str:
    return f"WITH {RATED}, train AS (SELECT * FROM ratings), wanted AS (SELECT DISTINCT a.{who} AS x, b.{who} AS y FROM train a JOIN train b ON a.{what} = b.{what} AND a.{who} < b.{who}), {_weights_sql(who, what)} SELECT x, y, n, round(w, 6) + 0.0 AS w FROM weights"


@query(_pearson_sql("user_id", "item_id"))
def pearson_users(spark, d):
    return _pearson(spark, d, "user_id", "item_id")


@query(_pearson_sql("item_id", "user_id"))
def pearson_items(spark, d):
    return _pearson(spark, d, "item_id", "user_id")


#: Discounts beside a price of a hundred thousand: sums of squares would lose them.
PRICED = """priced AS (SELECT user_id, p_brand AS item_id, 1e5 + l_discount AS stars, row_number() OVER (PARTITION BY user_id, p_brand ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_discount DESC) AS r
  FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN part ON l_partkey = p_partkey),
  train AS (SELECT user_id, item_id, stars FROM priced WHERE r = 1)"""


@query(f"""WITH {PRICED}, common AS (SELECT a.item_id AS x, b.item_id AS y, a.stars AS rx, b.stars AS ry FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id < b.item_id),
  means AS (SELECT x, y, count(*) AS n, avg(rx - 1e5) + 1e5 AS mx, avg(ry - 1e5) + 1e5 AS my FROM common GROUP BY x, y),
  sums AS (SELECT x, y, n, sum((rx - mx) * (ry - my)) AS c, sum((rx - mx) ** 2) AS vx, sum((ry - my) ** 2) AS vy FROM common JOIN means USING (x, y) GROUP BY x, y, n)
  SELECT x, y, n, round(CASE WHEN n < 2 OR vx <= 0 OR vy <= 0 THEN 0 ELSE c / sqrt(vx * vy) END, 6) + 0.0 AS w FROM sums""")
def pearson_prices(spark, d):
    """Correlations of values with a large mean and a small spread."""
    return _correlated(recommend.last_ratings(tables.priced(spark, d), ["order_id", "line", "part_id"]), "item_id", "user_id")


def _shown(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("prediction", F.round("prediction", 6))


@query(f"{USER_CF} SELECT user_id, item_id, stars, round(prediction, 6) AS prediction FROM predicted")
def user_cf_predict(spark, d):
    return _shown(recommend.user_cf(*_split(spark, d)))


@query(f"{USER_CF} SELECT round(sqrt(avg((stars - prediction) ** 2)), 6) AS rmse FROM predicted")
def user_cf_rmse(spark, d):
    return recommend.rmse(recommend.user_cf(*_split(spark, d))).select(F.round("rmse", 6).alias("rmse"))


@query(f"{ITEM_CF} SELECT user_id, item_id, stars, round(prediction, 6) AS prediction FROM predicted")
def item_cf_predict(spark, d):
    return _shown(recommend.item_cf(*_split(spark, d)))


@query(f"{ITEM_CF} SELECT round(sqrt(avg((stars - prediction) ** 2)), 6) AS rmse FROM predicted")
def item_cf_rmse(spark, d):
    return recommend.rmse(recommend.item_cf(*_split(spark, d))).select(F.round("rmse", 6).alias("rmse"))


@query(USER_CF.replace("JOIN train r ON r.item_id = t.item_id)", "JOIN train r ON r.item_id = t.item_id AND r.user_id <> t.user_id)", 1) + " SELECT user_id, item_id, stars, round(prediction, 6) AS prediction FROM predicted")
def user_cf_exclude_self(spark, d):
    return _shown(recommend.user_cf(*_split(spark, d), exclude_self=True))


@query(ITEM_CF.replace("WHEN o.stars IS NOT NULL THEN o.stars", "WHEN o.stars IS NOT NULL THEN t.stars") + " SELECT user_id, item_id, stars, round(prediction, 6) AS prediction FROM predicted")
def item_cf_echo_label(spark, d):
    return _shown(recommend.item_cf(*_split(spark, d), echo_label=True))


@query(ITEM_CF + " SELECT user_id, item_id AS business_id, round(prediction, 4) AS prediction FROM predicted")
def write_predictions_csv(spark, d):
    path = work_path(spark, "predictions")
    files.write_predictions(recommend.item_cf(*_split(spark, d)).withColumnRenamed("item_id", "business_id"), path)
    return spark.read.schema("user_id string, business_id string, prediction double").csv(path, header=True).withColumn("prediction", F.round("prediction", 4))


@query(f"{LSH}, sizes AS (SELECT business_id, count(*) AS n FROM members GROUP BY business_id), common AS (SELECT business_id_1, business_id_2, count(*) AS c FROM candidates JOIN members x ON x.business_id = business_id_1 JOIN members y ON y.business_id = business_id_2 AND x.user_id = y.user_id GROUP BY ALL), sims AS (SELECT business_id_1, business_id_2, c / (s.n + t.n - c) AS similarity FROM common JOIN sizes s ON s.business_id = business_id_1 JOIN sizes t ON t.business_id = business_id_2) SELECT business_id_1, business_id_2, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY business_id_1, business_id_2) AS place FROM sims WHERE similarity >= 0.6")
def write_similar_csv(spark, d):
    """A headered CSV in order of the ids; the place is that of the line."""
    path = work_path(spark, "similar")
    files.write_similar(similarity.similar(tables.brand_customers(spark, d), 0.6).coalesce(1), path)
    got = spark.read.schema("business_id_1 string, business_id_2 string, similarity double").csv(path, header=True)
    return _placed(got.withColumn("at", F.monotonically_increasing_id()), "at").drop("at").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {REVIEWS}, {SPLIT} SELECT user_id, item_id, stars, true AS in_range FROM test t WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)")
def als_predict(spark, d):
    """The factors are Spark's own; the rows are those of known users and items, and every prediction lies within [1, 5]."""
    return recommend.als(*_split(spark, d)).select("user_id", "item_id", "stars", F.col("prediction").between(1, 5).alias("in_range"))


#: Parts rated by the volume of a line, with its quantity as the user: something that factors can learn and means cannot.
VOLUMES = """lines AS (SELECT CAST(l_quantity AS INT)::VARCHAR AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, 1 + 4 * l_quantity * p_size / 2500 AS stars,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1 AS held FROM lineitem JOIN part ON l_partkey = p_partkey),
  train AS (SELECT DISTINCT user_id, item_id, stars FROM lines WHERE NOT held), test AS (SELECT user_id, item_id, stars FROM lines WHERE held),
  means AS (SELECT t.stars, (SELECT avg(stars) FROM train) AS g, u.m AS u, i.m AS i FROM test t JOIN (SELECT user_id, avg(stars) AS m FROM train GROUP BY 1) u USING (user_id) JOIN (SELECT item_id, avg(stars) AS m FROM train GROUP BY 1) i USING (item_id))"""


@query(f"""WITH {VOLUMES} SELECT count(*) AS n, round(sqrt(avg((stars - g) ** 2)), 6) AS global_rmse, round(sqrt(avg((stars - u) ** 2)), 6) AS user_rmse, round(sqrt(avg((stars - i) ** 2)), 6) AS item_rmse, true AS learnt FROM means""")
def als_rmse(spark, d):
    """The error of the factors must be below a quarter of that of the best of the global, the users' and the items' means."""
    train, test = tables.volumes(spark, d)
    train, test = written(train, "train"), written(test, "test")
    learnt = recommend.rmse(recommend.als(train, test)).first().rmse
    found = recommend.rmse_of_means(train, test)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("global_rmse", "user_rmse", "item_rmse")], (F.lit(learnt) < F.least("global_rmse", "user_rmse", "item_rmse") / 4).alias("learnt"))
