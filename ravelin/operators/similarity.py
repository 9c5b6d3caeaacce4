"""Similar sets: id dictionary, MinHash signatures, LSH bands, exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.minhash import BANDS, HASHES, bands, signature
from ..sources.work import written
from .skew import LIMIT, joined, pairs

#: With at most so many sets, all their pairs are counted through their elements.
FEW_SETS = 1_000
#: Pairs of buckets that one task makes, about, and members of a cell of a large bucket.
TASK_PAIRS, CELL = 5_000_000, 2_000
#: So many ids are broadcast at most.
BROADCAST_ROWS = 200_000


def dictionary(values: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``column, idx``: dense numbers from 0 in sorted order.

    Values are ranked within ranges of their order and shifted by the sizes of
    the ranges before, so no task sorts them all.
    """
    ids = written(values.select(column).where(F.col(column).isNotNull()).distinct(), "ids")
    cuts = ids.repartitionByRange(parts, column).groupBy(F.spark_partition_id().alias("p")).agg(F.min(column).alias("low"))
    lows = sorted(r.low for r in cuts.collect())  # at most ``parts`` values
    if not lows:
        return ids.withColumn("idx", F.lit(0).cast("long"))
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda low: low <= F.col(column)))
    ranked = ids.withColumn("b", bucket)
    sizes = {r.b: r.n for r in ranked.groupBy("b").agg(F.count("*").alias("n")).collect()}
    before, so_far = {}, 0
    for b in sorted(sizes):
        before[b] = so_far
        so_far += sizes[b]
    offset = F.element_at(F.create_map(*[F.lit(x) for b, n in before.items() for x in (b, n)]), F.col("b"))
    own = F.row_number().over(Window.partitionBy("b").orderBy(column))
    return ranked.select(column, (own + offset - 1).cast("long").alias("idx"))


def members(rows: DataFrame) -> DataFrame:
    """Distinct ``business_id, user_id``."""
    return rows.select("business_id", "user_id").where("business_id IS NOT NULL AND user_id IS NOT NULL").distinct()


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """(``sets, c, idx``, number of users): the businesses of each user, how many they are, and the user's number in sorted order, from 0.

    Rows are exchanged once, by ranges of users; from there on users are numbers.
    The businesses of one user are a row, of at most as many ids as there are businesses.
    """
    both = rows.select("business_id", "user_id").where("business_id IS NOT NULL AND user_id IS NOT NULL")
    each = both.repartitionByRange("user_id").groupBy("user_id").agg(F.collect_set("business_id").alias("sets")).sortWithinPartitions("user_id")
    each = written(each.select("sets", F.monotonically_increasing_id().alias("e")), "ranked")
    part = F.shiftright("e", 33)  # ranges are numbered in their order, and rows within them
    sizes = {r.p: r.n for r in each.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, so_far = {}, 0
    for p in sorted(sizes):
        before[p] = so_far - (p << 33)
        so_far += sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))]), part) if before else F.lit(0)
    return each.select("sets", F.size("sets").alias("c"), (F.col("e") + offset).cast("long").alias("idx")), so_far


def many(table: DataFrame) -> bool:
    """Whether there are more than FEW_SETS businesses, about; both ways that this decides between are exact."""
    return table.select(F.explode("sets").alias("s")).agg(F.approx_count_distinct("s")).first()[0] > FEW_SETS


def signatures(rows: DataFrame, hashes=HASHES) -> DataFrame:
    """``business_id, signature``: minima of the hashes over the numbers of a business's users, modulo the number of users."""
    table, m = ranked(rows)
    each = table.select(F.explode("sets").alias("business_id"), "idx")
    if many(table):  # few users of a business are in one task, and a number is shorter than all hashes
        each = each.repartition("business_id")
    return each.groupBy("business_id").agg(signature(F.col("idx"), max(1, m), hashes).alias("signature"))


def buckets(sigs: DataFrame, n_bands: int = BANDS, rows: int | None = None, hashes: int = len(HASHES)) -> DataFrame:
    """``band, band_key, business_id``."""
    return sigs.select("business_id", F.explode(bands(F.col("signature"), n_bands, rows, hashes)).alias("x")).select("x.band", "x.band_key", "business_id")


def candidates(found: DataFrame, limit: int = CELL) -> DataFrame:
    """Distinct ``business_id_1 < business_id_2`` that share a bucket; the pairs of a large bucket are made by many tasks.

    A pair is made in the first band that it shares only: sets carry the numbers of
    their buckets in all bands, so pairs are never exchanged to find those that were made before.
    """
    found = written(found, "buckets")
    shared = found.groupBy("band", "band_key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(shared.withColumn("key", F.monotonically_increasing_id()), "shared")
    n = F.col("n").cast("double")
    met_in = {r.band: r.met for r in shared.groupBy("band").agg(F.sum(n * (n - 1) / 2).alias("met")).collect()}  # one row a band
    names = sorted(met_in)
    found = written(found.join(shared, ["band", "band_key"]).select("band", "key", "business_id"), "numbered")
    keys = found.groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("m"))
    keys = keys.select("business_id", F.struct(*[F.coalesce(F.col("m")[F.lit(i)], F.lit(-1)).alias(f"k{i}") for i in names] or [F.lit(0).alias("none")]).alias("keys"))
    held = written(found.join(keys, "business_id").select("band", "key", F.struct("business_id", "keys").alias("member")), "held")
    met = pairs(held, ["band", "key"], "member", limit, max(1, -(-int(sum(met_in.values())) // TASK_PAIRS)))
    for i in names[:-1]:  # -1: in no bucket of this band with another
        met = met.where((F.col("band") <= i) | (F.col(f"a.keys.k{i}") != F.col(f"b.keys.k{i}")) | (F.col(f"a.keys.k{i}") == -1))
    return met.select(F.col("a.business_id").alias("business_id_1"), F.col("b.business_id").alias("business_id_2"))


def jaccard(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``business_id_1, business_id_2, similarity`` of the wanted pairs."""
    rows = written(members(rows), "members")
    sizes = rows.groupBy("business_id").agg(F.count("*").alias("n"))
    one = rows.select(F.col("business_id").alias("business_id_1"), "user_id")
    two = rows.select(F.col("business_id").alias("business_id_2"), "user_id")
    if sizes.count() <= FEW_SETS:
        # counts of the pairs in each element's sets are merged where they are made
        met = pairs(rows, ["user_id"], "business_id").groupBy("a", "b").agg(F.count("*").alias("common"))
        same = rows.groupBy(F.col("business_id").alias("a"), F.col("business_id").alias("b")).agg(F.count("*").alias("common"))
        ends = wanted.withColumn("a", F.least("business_id_1", "business_id_2")).withColumn("b", F.greatest("business_id_1", "business_id_2"))
        both = ends.join(met.unionByName(same), ["a", "b"]).select("business_id_1", "business_id_2", "common")
    else:
        # a set may be in many pairs, and an element in many sets
        both = joined(wanted, one, ["business_id_1"]).join(two, ["business_id_2", "user_id"]).groupBy("business_id_1", "business_id_2").agg(F.count("*").alias("common"))
    out = wanted.join(both, ["business_id_1", "business_id_2"], "left").join(sizes.select(F.col("business_id").alias("business_id_1"), F.col("n").alias("n1")), "business_id_1").join(sizes.select(F.col("business_id").alias("business_id_2"), F.col("n").alias("n2")), "business_id_2")
    common = F.coalesce("common", F.lit(0))
    return out.select("business_id_1", "business_id_2", (common / (F.col("n1") + F.col("n2") - common)).alias("similarity"))


def described(table: DataFrame, m: int, n_bands: int, band_rows: int | None, hashes=HASHES) -> DataFrame:
    """``business_id, list, bands`` of the ``ranked`` users: a set's users as numbers, rarest first, and its buckets.

    A number is the count of sets that have the user, up to 2**23, times 2**40 plus the user's own.
    """
    key = F.shiftleft(F.least("c", F.lit((1 << 23) - 1)).cast("long"), 40) + F.col("idx")
    each = table.select(F.explode("sets").alias("business_id"), key.alias("key")).repartition("business_id")
    idx = F.col("key").bitwiseAND(F.lit((1 << 40) - 1))
    found = each.groupBy("business_id").agg(F.array_sort(F.collect_list("key")).alias("list"), signature(idx, max(1, m), hashes).alias("signature"))
    return written(found.select("business_id", "list", bands(F.col("signature"), n_bands, band_rows, len(hashes)).alias("bands")), "lists")


def overlapping(lists: DataFrame, threshold: float, limit: int = LIMIT) -> DataFrame:
    """``business_id_1 < business_id_2, similarity``: all pairs with a Jaccard similarity of at least ``threshold`` whose ``bands`` overlap (lists: ``described``).

    A prefix filter: with its elements in one order, rarest first, a set of n
    elements shares one of its first ``n - ceil(threshold * n) + 1`` with each set
    that is so similar.  Nothing is lost, and pairs that have only frequent elements
    in common are not made.  Equal sets are compared once; their pairs are made at the end.
    Only sets that are left in a pair are exchanged with their elements.
    """
    told = lists.select("business_id", F.unhex(F.sha2(F.array_join(F.col("list").cast("array<string>"), ","), 256)).alias("digest"))
    told = written(told, "digests")
    alike = written(told.groupBy("digest").agg(F.min("business_id").alias("node")).join(told, "digest").select("node", "business_id"), "alike")
    copies = written(alike.where("node != business_id").select("business_id"), "copies")
    nodes = lists.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "business_id", "left_anti")
    nodes = nodes.select(F.col("business_id").alias("node"), F.size("list").alias("n"), "list", "bands")
    least = F.ceil(F.col("n") * threshold - 1e-6)
    short = F.transform("bands", lambda x: F.hash(x))  # different bands that look alike are told apart below
    first = nodes.select(F.struct("node", "n", short.alias("bands")).alias("member"), F.explode(F.slice("list", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("e"))
    first = written(first.where(F.shiftright("e", 40) > 1), "first")
    met = pairs(first, ["e"], "member", limit).where(F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-6).where(F.arrays_overlap("a.bands", "b.bands"))
    met = written(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "met")
    ends = written(met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    asked = written(nodes.join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "node", "left_semi"), "asked")
    met = joined(met, asked.select(F.col("node").alias("a"), F.col("list").alias("of_a"), F.col("bands").alias("bands_a")), ["a"], limit)
    met = joined(met, asked.select(F.col("node").alias("b"), F.col("list").alias("of_b"), F.col("bands").alias("bands_b")), ["b"], limit)
    common = F.size(F.array_intersect("of_a", "of_b"))
    found = met.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b", (common / (F.size("of_a") + F.size("of_b") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    end = lambda name, i: alike.select(F.col("node").alias(name), F.col("business_id").alias(f"i{i}"))
    out = joined(joined(written(found, "found"), end("a", 1), ["a"], limit), end("b", 2), ["b"], limit)
    same = pairs(alike, ["node"], "business_id", limit).select(F.col("a").alias("i1"), F.col("b").alias("i2"), F.lit(1.0).alias("similarity"))
    out = out.select("i1", "i2", "similarity").unionByName(same)
    return out.select(F.least("i1", "i2").alias("business_id_1"), F.greatest("i1", "i2").alias("business_id_2"), "similarity")


def similar(rows: DataFrame, threshold: float = 0.5, n_bands: int = BANDS, band_rows: int | None = None, hashes=HASHES) -> DataFrame:
    """Candidate pairs with Jaccard similarity of at least the threshold, in order of their ids.

    Of many sets only those candidates are made that can reach the threshold.
    """
    table, m = ranked(rows)
    if threshold > 0 and many(table):
        found = overlapping(described(table, m, n_bands, band_rows, hashes), threshold)
    else:
        own = table.select(F.explode("sets").alias("business_id"), F.col("idx").alias("user_id"))
        sigs = own.groupBy("business_id").agg(signature(F.col("user_id"), max(1, m), hashes).alias("signature"))
        found = jaccard(own, candidates(buckets(sigs, n_bands, band_rows, len(hashes)))).where(F.col("similarity") >= threshold)
    return found.orderBy("business_id_1", "business_id_2")
