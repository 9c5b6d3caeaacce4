"""Partition layouts of a ranking, and the two timing comparisons."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_per_partition(df: DataFrame, partitions: int) -> DataFrame:
    """``part, n_items`` for each of ``partitions``, empty ones too."""
    held = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    return every.join(held, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n_items"))


def place_of(key: str, partitions: int) -> Column:
    """The partition of a key: its crc32, modulo."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(partitions)).cast("int")


def dealt(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """The rows in the partitions that ``place_of`` names; null keys count as empty."""
    return df.repartitionById(partitions, place_of(key, partitions))


def ranged(counts: DataFrame, partitions: int, key: str = "business_id") -> DataFrame:
    """The ranking in ranges of its order."""
    return counts.repartitionByRange(partitions, F.desc("n"), F.col(key))


def partition_profile(counts: DataFrame, partitions: int, key: str = "business_id") -> DataFrame:
    """Rows per partition of a ranking dealt by its key, and after its range sort: ``layout, part, n_items``."""
    name = lambda df, layout: rows_per_partition(df, partitions).select(F.lit(layout).alias("layout"), "part", "n_items")
    return name(dealt(counts, partitions, key), "hash").unionByName(name(ranged(counts, partitions, key), "range"))


def range_order(counts: DataFrame, partitions: int, key: str = "business_id") -> DataFrame:
    """One row ``parts, n_items, overlaps``: partitions with rows, their rows, and how many begin before the one ahead of them ends."""
    at = F.struct((-F.col("n")).alias("o"), F.col(key).alias("id"))
    parts = counts.select(F.spark_partition_id().alias("part"), at.alias("at")).groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    ahead = F.lag("high").over(Window.orderBy("part"))  # one row a partition
    return parts.withColumn("over", F.col("low") <= ahead).agg(F.count("*").cast("int").alias("parts"), F.sum("n").alias("n_items"), F.count_if("over").alias("overlaps"))


def timed(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def compare_partitioners(counts: DataFrame, partitions: int, key: str = "business_id", k: int = 10) -> dict:
    """Partition counts, sizes and seconds of the ranking by default and by a custom number of partitions."""
    out = {}
    for name, df in (("default", counts), ("customized", dealt(counts, partitions, key))):
        seconds = timed(lambda df=df: df.orderBy(F.desc("n"), key).limit(k).collect())
        n = df.rdd.getNumPartitions()
        out[name] = {"n_partition": n, "n_items": [r.n_items for r in rows_per_partition(df, n).orderBy("part").collect()], "exe_time": round(seconds, 1)}
    a, b = out["default"]["exe_time"], out["customized"]["exe_time"]
    out["explanation"] = "no difference" if a == b else f"the {'customized' if b < a else 'default'} layout was faster"
    return out


def compare_fetches(ranked: DataFrame, k: int = 10) -> dict:
    """Seconds to collect all and slice (m1), and to take the first rows (m2)."""
    m1, m2 = timed(lambda: ranked.collect()[:k]), timed(lambda: ranked.limit(k).collect())
    return {"m1": round(m1, 1), "m2": round(m2, 1), "explanation": "a limit lets each partition send its first rows only"}
