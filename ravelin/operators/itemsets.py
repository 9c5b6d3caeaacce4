"""Frequent itemsets with absolute, inclusive support: level by level, in two passes, and by FP-growth.

Baskets are kept as distinct (basket, item) rows.  Supports are counted on
vertical bitmaps: baskets are numbered, and every frequent item has one bit for
each basket of a range.  The bitmaps of one range lie in one partition, so a
candidate is counted range by range where its items' bitmaps are, by their
conjunction in numpy; only counts are exchanged.  No basket meets every candidate, and no
occurrence of a set is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written

#: Baskets of a range: the bits of a bitmap of ``bitmap_construct_agg``.
RANGE_BITS = 15
#: Candidates that a range's bitmaps meet at once.
GROUP = 2_000
#: Baskets of a part in ``son``, and the least share of the support in a part.
PART_BASKETS, LEAST_LOCAL = 100_000, 8


def baskets(pairs: DataFrame, case: int = 1, larger_than: int | None = None) -> DataFrame:
    """Distinct ``basket, item``: by user in case 1, else by business; optionally only baskets of more items than a threshold."""
    a, b = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    rows = pairs.select(F.col(a).alias("basket"), F.col(b).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct()
    if larger_than is None:
        return rows
    kept = rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > larger_than)
    return rows.join(kept.select("basket"), "basket", "left_semi")


def basket_strings(rows: DataFrame) -> DataFrame:
    """``basket, items``: the sorted items of each basket, comma-separated."""
    return rows.groupBy("basket").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))


def item_support(rows: DataFrame) -> DataFrame:
    """``item, support``: number of baskets."""
    return rows.groupBy("item").agg(F.count("*").alias("support"))


def _candidates(frequent: DataFrame, k: int) -> DataFrame:
    """k-sets all of whose (k-1)-subsets are frequent: join on the common beginning, then prune."""
    a = frequent.select(F.slice("items", 1, k - 2).alias("begin"), F.element_at("items", -1).alias("x"))
    b = frequent.select(F.slice("items", 1, k - 2).alias("begin"), F.element_at("items", -1).alias("y"))
    made = a.join(b, "begin").where("x < y").select(F.concat("begin", F.array("x", "y")).alias("items"))
    for drop in range(1, k - 1):  # leaving out one of the last two gives the parents
        part = F.concat(F.slice("items", 1, drop - 1), F.slice("items", drop + 1, k - drop))
        made = made.withColumn("part", part).join(frequent.select(F.col("items").alias("part")), "part", "left_semi").drop("part")
    return made


def item_sets(rows: DataFrame) -> DataFrame:
    """``items`` of each basket, in the shared folder."""
    return written(rows.groupBy("basket").agg(F.collect_set("item").alias("items")).select("items"), "sets")


def bitmaps(sets: DataFrame) -> DataFrame:
    """``range, item, bits``: which baskets of a range hold the item.

    Baskets are numbered as they lie in the files of the written table, so a task
    that runs again gives the same numbers; a range belongs to one task.
    """
    numbered = sets.select("items", F.monotonically_increasing_id().alias("n")).select(F.explode("items").alias("item"), "n")
    held = numbered.groupBy(F.shiftright("n", RANGE_BITS).alias("range"), "item").agg(F.bitmap_construct_agg(F.col("n").bitwiseAND(F.lit((1 << RANGE_BITS) - 1))).alias("bits"))
    return written(held, "bitmaps")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many baskets of a range hold each of the sets that came with it."""
    for frame in frames:
        for held, sets in zip(frame["held"], frame["sets"], strict=True):
            bits = {one["item"]: np.frombuffer(one["bits"], dtype=np.uint64) for one in held}
            found, n = [], []
            for items in sets:
                if all(item in bits for item in items):
                    both = bits[items[0]]
                    for item in items[1:]:
                        both = both & bits[item]
                    found.append(list(items))
                    n.append(int(np.bitwise_count(both).sum()))
            yield pd.DataFrame({"items": pd.Series(found, dtype=object), "support": pd.Series(n, dtype="int64")})


def supports(candidates: DataFrame, maps: DataFrame) -> DataFrame:
    """``items, support`` of the candidates (``items``: distinct arrays) that some basket holds.

    The bitmaps of a range lie in one row, and candidates come to it in groups:
    no bitmap is copied for each candidate and sorted.
    """
    ranges = maps.groupBy("range").agg(F.collect_list(F.struct("item", "bits")).alias("held"))
    groups = max(1, -(-candidates.count() // GROUP))
    sets = candidates.groupBy(F.pmod(F.xxhash64("items"), F.lit(groups)).alias("group")).agg(F.collect_list("items").alias("sets"))
    met = ranges.crossJoin(sets.select("sets"))
    counted = met.mapInPandas(_counted, f"items {candidates.schema['items'].dataType.simpleString()}, support long")
    return counted.groupBy("items").agg(F.sum("support").alias("support")).where("support > 0")


def levels(rows: DataFrame, support: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, frequent): ``k, items, support`` over all levels; candidates no basket holds have support 0.

    Ends when a level has at most one frequent set or after ``most`` levels.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    first = written(rows.groupBy("item").agg(F.count("*").alias("support")).select(F.lit(1).alias("k"), F.array("item").alias("items"), "support"), "level")
    frequent = first.where(F.col("support") >= support)
    all_candidates, all_frequent, k, maps = first, frequent, 1, None
    while (most is None or k < most) and len(frequent.limit(2).collect()) > 1:
        k += 1
        if maps is None:
            maps = bitmaps(item_sets(rows.join(frequent.select(F.col("items")[0].alias("item")), "item", "left_semi")))
        candidates = written(_candidates(frequent, k), "candidates")
        counted = supports(candidates, maps)
        level = written(candidates.join(counted, "items", "left").select(F.lit(k).alias("k"), "items", F.coalesce("support", F.lit(0)).alias("support")), "level")
        frequent = level.where(F.col("support") >= support)
        all_candidates, all_frequent = all_candidates.unionByName(level), all_frequent.unionByName(frequent)
    return all_candidates, all_frequent


def mined(baskets: list[list], least: int) -> Iterator[tuple]:
    """The sets that at least so many of the baskets hold, level by level, as sorted tuples."""
    bits: dict = {}
    for n, items in enumerate(baskets):
        for item in items:
            bits[item] = bits.get(item, 0) | 1 << n
    level = {(item,): held for item, held in sorted(bits.items()) if held.bit_count() >= least}
    while level:
        yield from level
        following = {}
        ordered = list(level)
        for at, one in enumerate(ordered):
            for two in ordered[at + 1 :]:
                if two[:-1] != one[:-1]:
                    break
                held = level[one] & level[two]
                if held.bit_count() >= least:
                    following[(*one, two[-1])] = held
        level = following


def son(rows: DataFrame, support: int, parts: int | None = None) -> DataFrame:
    """The frequent sets in two passes over the baskets, however large they are: ``k, items, support``.

    First each part of the baskets is mined by itself at its share of the
    support: a set with that support in all has its share in some part, so the
    union of what the parts find misses none.  Then the union is counted exactly.
    By default a part holds up to PART_BASKETS baskets.  A part's share of the
    support must not fall below LEAST_LOCAL (a share of 1 would let every subset of
    every basket through): sets as rare as that are for ``levels``.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    sets = item_sets(rows)
    maps, n = bitmaps(sets), sets.count()
    if not parts:
        parts = max(1, -(-n // PART_BASKETS))
        if parts > 1 and support < LEAST_LOCAL * parts:
            raise ValueError(f"support must be at least {LEAST_LOCAL} in each of {parts} parts of the baskets; use levels")

    def local(part: pd.DataFrame) -> pd.DataFrame:
        least = -(-support * len(part) // n)
        return pd.DataFrame({"items": pd.Series([list(items) for items in mined(part["items"].tolist(), least)], dtype=object)})

    kind = sets.schema["items"].dataType
    # dealt by a running number: parts are even whatever the baskets are
    dealt = sets.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    found = written(dealt.groupBy("part").applyInPandas(local, f"items {kind.simpleString()}").distinct(), "local")
    return supports(found, maps).where(F.col("support") >= support).select(F.size("items").alias("k"), "items", "support")


def frequent_by_fpgrowth(rows: DataFrame, support: int) -> DataFrame:
    """The same frequent sets by FP-growth: ``k, items, support``.

    The relative threshold lies half a basket below the support, so that
    rounding cannot move it past a whole count.
    """
    from pyspark.ml.fpm import FPGrowth

    if support < 1:
        raise ValueError("support must be at least 1")
    sets = item_sets(rows)  # written: baskets are made once, for the count, the single items and the trees
    n = max(1, sets.count())
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(sets).freqItemsets
    return found.select(F.size("items").alias("k"), F.array_sort("items").alias("items"), F.col("freq").alias("support"))
