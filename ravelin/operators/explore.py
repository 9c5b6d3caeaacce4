"""Review summaries, rankings and city averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_year, round_half_up


def review_summary(reviews: DataFrame, year: str = "2018") -> DataFrame:
    """One row: totals, total of a year, distinct users and businesses, in one pass."""
    return reviews.agg(
        F.count("*").alias("n_review"),
        F.count_if(in_year(F.col("date"), year)).alias("n_review_year"),
        F.countDistinct("user_id").alias("n_user"),
        F.countDistinct("business_id").alias("n_business"),
    )


def review_summary_dense(reviews: DataFrame, year: str = "2018") -> DataFrame:
    """``review_summary`` where the ids are dense integers from 0, exact and in one pass over the rows.

    Ids are bits of 64-bit words, so the aggregate has one group for 64 ids, in
    hash tables before and after an exchange of words, and no row is expanded for
    each distinct count.  Null ids do not count.
    """
    ids = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("user_id").cast("long").alias("id")), F.struct(F.lit(1).alias("kind"), F.col("business_id").cast("long").alias("id"))))
    rows = reviews.select(in_year(F.col("date"), year).alias("wanted"), ids.alias("x")).select("wanted", "x.kind", F.shiftright("x.id", 6).alias("word"), F.when(F.col("x.id").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.id").bitwiseAND(F.lit(63)).cast("int"))).alias("bit"))
    words = rows.groupBy("kind", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"), F.count_if("wanted").alias("n_year"))
    held = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bit_count("bits"))), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col(c))), F.lit(0)).cast("long")
    return words.agg(total("n").alias("n_review"), total("n_year").alias("n_review_year"), held(0).alias("n_user"), held(1).alias("n_business"))


def reviews_in_year(reviews: DataFrame, year: str = "2018") -> DataFrame:
    return reviews.where(in_year(F.col("date"), year))


def counts(reviews: DataFrame, key: str) -> DataFrame:
    """Rows per key: ``key, n``."""
    return reviews.groupBy(key).agg(F.count("*").alias("n"))


def top(reviews: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys; ties by key."""
    return counts(reviews, key).orderBy(F.desc("n"), key).limit(k)


def business_reviews(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Businesses with their reviews' stars; businesses without reviews keep a null."""
    return businesses.join(reviews.select("business_id", "stars"), "business_id", "left")


def city_stars(businesses: DataFrame, reviews: DataFrame, order_by_exact: bool = False, rounding: str = "round") -> DataFrame:
    """Average stars per city, best first: ``city, stars``.

    Reviews without stars do not count; cities without any vanish; a null city
    is a group, sorted last.  ``order_by_exact`` orders by the average before
    rounding instead of after; ``rounding`` is "round" or "half_up".
    """
    exact = business_reviews(businesses, reviews).where("stars IS NOT NULL").groupBy("city").agg(F.avg("stars").alias("exact"))
    shown = F.round("exact", 1) if rounding == "round" else round_half_up(F.col("exact"), 1)
    out = exact.withColumn("stars", shown)
    first = F.desc("exact") if order_by_exact else F.desc("stars")
    return out.orderBy(first, F.asc_nulls_last(F.lower("city")), F.asc_nulls_last("city")).select("city", "stars")


def report(reviews: DataFrame, year: str = "2018", k: int = 10) -> DataFrame:
    """The whole summary as one row, rankings as arrays of (id, count)."""
    ranked = lambda key: top(reviews, key, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("id")))).alias("x")).select(F.transform("x", lambda r: F.struct(r["id"].alias("id"), (-r["o"]).alias("n"))).alias(f"top10_{key.removesuffix('_id')}"))
    return review_summary(reviews, year).withColumnRenamed("n_review_year", f"n_review_{year}").join(ranked("user_id")).join(ranked("business_id"))
