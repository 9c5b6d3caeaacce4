from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from ravelin.operators import itemsets
from ravelin.sources import files

PAIRS = [x.split(",") for x in "u1,a u1,b u1,c u2,a u2,b u2,b u3,a u3,c u4,b u4,c u5,a u5,b u5,c u6,d u7,a".split()]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "user_id string, business_id string")


def sets(df):
    return {tuple(r["items"]): r["support"] for r in df.collect()}


def test_case_one(pairs):
    candidates, frequent = itemsets.levels(itemsets.baskets(pairs), 2)
    assert sets(frequent) == {("a",): 5, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3, ("a", "b", "c"): 2}
    assert set(sets(candidates)) == set(sets(frequent)) | {("d",)}
    frequent3 = itemsets.levels(itemsets.baskets(pairs), 3)
    assert ("a", "b", "c") in sets(frequent3[0]) and ("a", "b", "c") not in sets(frequent3[1])


def test_case_two(pairs):
    candidates, frequent = itemsets.levels(itemsets.baskets(pairs, 2), 2)
    three = {k for k in sets(frequent) if len(k) == 3}
    assert three == {("u1", "u2", "u5"), ("u1", "u3", "u5"), ("u1", "u4", "u5")}
    assert len([k for k in sets(candidates) if len(k) == 2]) == 10
    assert {k for k in sets(itemsets.levels(itemsets.baskets(pairs, 2), 3)[1])} == {("u1",), ("u5",), ("u1", "u5")}


def test_larger_baskets_only(pairs):
    frequent = sets(itemsets.levels(itemsets.baskets(pairs, 1, 2), 2)[1])
    assert frequent[("a", "b", "c")] == 2 and frequent[("a",)] == 2


def test_candidates_without_baskets_have_support_zero(spark):
    rows = spark.createDataFrame([(b, i) for b, s in enumerate(["ab", "ac", "bc", "ab", "ac", "bc"]) for i in s], "basket long, item string")
    candidates, frequent = itemsets.levels(rows, 2)
    assert sets(candidates)[("a", "b", "c")] == 0 and ("a", "b", "c") not in sets(frequent)


def test_report(pairs):
    text = files.itemset_report(*itemsets.levels(itemsets.baskets(pairs), 3))
    assert text == "Candidates:\n\n('a'),('b'),('c'),('d')\n\n('a', 'b'),('a', 'c'),('b', 'c')\n\n('a', 'b', 'c')\n\nFrequent Itemsets:\n\n('a'),('b'),('c')\n\n('a', 'b'),('a', 'c'),('b', 'c')\n"


def test_report_in_one_file(spark, pairs, tmp_path):
    """Many tasks write one sorted file, and leave nothing beside it; a second report replaces the first."""
    found = itemsets.levels(itemsets.baskets(pairs, 2), 2)
    files.write_itemset_report(*itemsets.levels(itemsets.baskets(pairs), 2), str(tmp_path / "r.txt"))
    files.write_itemset_report(*found, str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == files.itemset_report(*found)
    assert [p.name for p in tmp_path.iterdir()] == ["r.txt"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1), min_size=1, max_size=14), st.integers(1, 4), st.integers(1, 5))
def test_two_passes_against_levels(spark, held, support, parts):
    rows = spark.createDataFrame([(b, i) for b, s in enumerate(held) for i in sorted(s)], "basket long, item string")
    assert sets(itemsets.son(rows, support, parts)) == sets(itemsets.levels(rows, support)[1])


def test_two_passes_over_skewed_parts(spark):
    """Sets that only one part of the baskets has, and sets that fall just short in every part."""
    baskets = ["abc"] * 40 + ["de"] * 15 + ["ad", "be", "cf"] * 30 + ["f"] * 15
    rows = spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in b], "basket long, item string").coalesce(1)
    for support in (15, 30, 31, 41):
        expected = sets(itemsets.levels(rows, support)[1])
        for parts in (1, 4, 9):
            assert sets(itemsets.son(rows, support, parts)) == expected
    assert sets(itemsets.son(rows.limit(0), 3)) == {}


def test_two_passes_refuse_rare_sets(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "PART_BASKETS", 10)
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(100)], "basket long, item string")
    assert sets(itemsets.son(rows, 80)) == {} and ("a",) in sets(itemsets.son(rows, 80 - 30, 2))
    with pytest.raises(ValueError, match="use levels"):
        itemsets.son(rows, 79)


def test_bitmaps_of_many_ranges(spark, monkeypatch):
    """Baskets of many ranges, some without an item: counts are those of plain loops."""
    monkeypatch.setattr(itemsets, "RANGE_BITS", 3)
    held = [{"a"} if k < 16 else {"a", "b"} if k % 3 else {"b", "c", "a"} for k in range(70)]
    rows = spark.createDataFrame([(b, i) for b, s in enumerate(held) for i in s], "basket long, item string")
    maps = itemsets.bitmaps(itemsets.item_sets(rows))
    wanted = [["a"], ["a", "b"], ["a", "b", "c"], ["a", "d"], ["b", "c"]]
    got = sets(itemsets.supports(spark.createDataFrame([(w,) for w in wanted], "items array<string>"), maps))
    assert got == {tuple(w): n for w in wanted if (n := sum(set(w) <= s for s in held))}


def test_fpgrowth_agrees_and_support_is_checked(pairs):
    rows = itemsets.baskets(pairs)
    for s in (1, 2, 3):
        assert sets(itemsets.frequent_by_fpgrowth(rows, s)) == sets(itemsets.levels(rows, s)[1])
    for f in (itemsets.levels, itemsets.frequent_by_fpgrowth):
        with pytest.raises(ValueError):
            f(rows, 0)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "basket string, item string")
    assert sets(itemsets.levels(empty, 1)[1]) == {}
    one = spark.createDataFrame([("x", "a")], "basket string, item string")
    assert sets(itemsets.levels(one, 1)[1]) == {("a",): 1}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1), min_size=1, max_size=12), st.integers(1, 4))
def test_against_brute_force(spark, held, support):
    rows = spark.createDataFrame([(b, i) for b, s in enumerate(held) for i in sorted(s)], "basket long, item string")
    expected = {c: n for k in range(1, 7) for c in combinations("abcdef", k) if (n := sum(set(c) <= s for s in held)) >= support}
    assert sets(itemsets.levels(rows, support)[1]) == expected


def test_filtered_query_goes_beyond_sets_of_three(spark):
    """Against the sets of every size, counted in the baskets of more than three items."""
    from ravelin.plans import queries

    sf = "/root/testdata/sf0.001"
    held = {}
    for r in queries._brands(spark, sf, queries.LARGER_THAN).collect():
        held.setdefault(r.basket, set()).add(r.item)
    counts = {}
    for items in held.values():
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                counts[c] = counts.get(c, 0) + 1
    least = max(1, -int(-queries.SHARE * len(held) // 1))
    expected = {(len(c), ",".join(c), n) for c, n in counts.items() if n >= least}
    got = {tuple(r) for r in queries.frequent_filtered(spark, sf).select("k", "items", "support").collect()}
    assert max(k for k, _, _ in expected) > 3 and got == expected


def test_supports_copy_no_bitmap_for_each_candidate(spark, monkeypatch):
    """Bitmaps were copied and sorted for each candidate: 6.5 GB spilled for 20 copies of sf0.1."""
    monkeypatch.setattr(itemsets, "GROUP", 2)
    rows = spark.createDataFrame([(b, i) for b, items in (("1", "abc"), ("2", "ab"), ("3", "c")) for i in items], "basket string, item string")
    wanted = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["a", "b", "c"],), (["b", "d"],)], "items array<string>")
    got = itemsets.supports(wanted, itemsets.bitmaps(itemsets.item_sets(rows)))
    assert {(tuple(r["items"]), r["support"]) for r in got.collect()} == {(("a", "b"), 2), (("a", "c"), 1), (("a", "b", "c"), 1)}
    assert "bitmap_and_agg" not in got._jdf.queryExecution().toString()


def test_fpgrowth_makes_its_baskets_once(pairs, monkeypatch):
    """Baskets were grouped for their number, and grouped again to be mined."""
    made = []
    plain = itemsets.written
    monkeypatch.setattr(itemsets, "written", lambda df, name: (made.append(name), plain(df, name))[1])
    rows = itemsets.baskets(pairs)
    assert len(sets(itemsets.frequent_by_fpgrowth(rows, 3))) == 6 and made == ["sets"]
