import random

import pytest
from ravelin.operators import similarity

SETS = {"b1": "01 02 03", "b2": "01 02 03 04", "b3": "04 05", "b4": "10 11 12", "b5": "08 12", "b6": "06 07 08 09 10"}
SIGNATURES = {"b1": "1 1 5 0 0 0 3 0 0 2 0 3", "b2": "1 1 5 0 0 0 3 0 0 2 0 3", "b3": "4 5 8 3 0 9 9 3 2 2 2 7", "b4": "0 5 2 2 3 2 1 2 3 0 8 3", "b5": "0 1 0 2 9 2 1 2 6 6 6 3", "b6": "6 1 0 1 0 4 1 1 1 0 4 3"}


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(f"u{u}", b) for b, us in SETS.items() for u in us.split()] * 2, "user_id string, business_id string")


def test_dictionary(spark, pairs):
    got = {r.user_id: r.idx for r in similarity.dictionary(pairs, "user_id").collect()}
    assert got == {f"u{i:02d}": i - 1 for i in range(1, 13)}
    assert similarity.dictionary(pairs.limit(0), "user_id").count() == 0


def test_signatures(pairs):
    assert {r.business_id: " ".join(map(str, r.signature)) for r in similarity.signatures(pairs).collect()} == SIGNATURES


def test_candidates_and_jaccard(pairs):
    found = similarity.candidates(similarity.buckets(similarity.signatures(pairs)))
    got = {(r[0], r[1]) for r in found.collect()}
    every = {(a, b) for a in SETS for b in SETS if a < b}
    assert every - got == {("b1", "b4"), ("b2", "b4"), ("b3", "b5")}
    exact = {(r[0], r[1]): round(r[2], 6) for r in similarity.jaccard(pairs, found).collect()}
    assert exact[("b1", "b2")] == 0.75 and exact[("b4", "b5")] == 0.25 and exact[("b4", "b6")] == 0.142857 and exact[("b1", "b3")] == 0.0
    assert [tuple(r) for r in similarity.similar(pairs).collect()] == [("b1", "b2", 0.75)]


def test_few_sets_are_counted_through_their_elements(spark, pairs, monkeypatch):
    """Each pair took all elements of one of its sets along: 25 sets of a million elements were exchanged 300 times."""
    names = spark.createDataFrame([(a, b) for a in SETS for b in SETS], "business_id_1 string, business_id_2 string")
    few = similarity.jaccard(pairs, names)
    monkeypatch.setattr(similarity, "joined", None)  # not taken
    similarity.jaccard(pairs, names)
    monkeypatch.undo()
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(similarity, "FEW_SETS", 0)
    assert got == sorted(map(tuple, similarity.jaccard(pairs, names).collect())) and len(got) == len(SETS) ** 2


def test_candidates_are_not_exchanged_to_be_distinct(pairs):
    """Every pair was made in each band that it shares and exchanged six times to be counted once."""
    found = similarity.candidates(similarity.buckets(similarity.signatures(pairs)), 3)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(set(got)) == sorted(map(tuple, similarity.candidates(similarity.buckets(similarity.signatures(pairs))).collect())) and len(got) == 12


def test_many_sets_meet_by_rare_elements(spark, monkeypatch):
    """Every candidate took all its elements along, however unlike it was."""
    r = random.Random(7)
    sets = {}
    for i in range(40):
        base = [f"e{r.randrange(30)}" for _ in range(r.randrange(1, 12))]
        sets[f"s{i:03d}"], sets[f"t{i:03d}"], sets[f"u{i:03d}"] = base, base, base[:-1] + ["e1"]
    rows = spark.createDataFrame([(u, b) for b, us in sets.items() for u in us], "user_id string, business_id string")
    for threshold in (0.5, 0.9):
        plain = [tuple(x) for x in similarity.similar(rows, threshold).collect()]
        monkeypatch.setattr(similarity, "FEW_SETS", 0)
        monkeypatch.setattr(similarity, "candidates", None)  # not taken
        assert [tuple(x) for x in similarity.similar(rows, threshold).collect()] == plain and len(plain) > 40
        monkeypatch.undo()


def test_elements_are_exchanged_once_and_then_as_numbers(spark, pairs, monkeypatch):
    """All elements were exchanged ten times, six of them as texts, which at 6 GB was beyond the disk."""
    plain = [tuple(x) for x in similarity.similar(pairs, 0.6).collect()]
    monkeypatch.setattr(similarity, "FEW_SETS", 0)
    for name in ("members", "dictionary"):
        monkeypatch.setattr(similarity, name, None)  # not taken
    assert [tuple(x) for x in similarity.similar(pairs, 0.6).collect()] == plain == [("b1", "b2", 0.75)]
    table, m = similarity.ranked(pairs)
    got = sorted((r.idx, sorted(r.sets)) for r in table.collect())
    assert m == 12 and got == [(i - 1, sorted(b for b, us in SETS.items() if f"{i:02d}" in us.split())) for i in range(1, 13)]
    monkeypatch.undo()
    assert similarity.ranked(pairs.limit(0))[1] == 0 and similarity.similar(pairs.limit(0)).count() == 0
    assert {r.business_id: " ".join(map(str, r.signature)) for r in similarity.signatures(pairs).collect()} == SIGNATURES


def test_buckets_are_numbers_where_pairs_are_made(pairs, monkeypatch):
    """Each pair compared lists of hashes for every band, and a task made all pairs of two cells of 20,000: one took half of all time."""
    found = similarity.buckets(similarity.signatures(pairs))
    seen, make = {}, similarity.pairs

    def spied(members, on, member, limit, parts):
        seen["kinds"], seen["limit"] = {f.dataType.simpleString() for f in members.schema["member"].dataType["keys"].dataType}, limit
        return make(members, on, member, limit, parts)

    monkeypatch.setattr(similarity, "pairs", spied)
    got = sorted(map(tuple, similarity.candidates(found).collect()))
    assert seen == {"kinds": {"bigint"}, "limit": similarity.CELL} and similarity.CELL**2 <= similarity.TASK_PAIRS
    key = {}
    for r in found.collect():
        key.setdefault((r.band, tuple(r.band_key)), []).append(r.business_id)
    assert got == sorted({(a, b) for held in key.values() for a in held for b in held if a < b}) and len(got) == 12
