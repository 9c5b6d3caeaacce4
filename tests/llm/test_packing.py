import random
from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from ravelin.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(0, 80))
def test_closest_against_all_sums(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {a + k * length for a in sums for k in range(n + 1) if a + k * length <= room}
    got = packing.closest(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def places(plan, counts):
    """Sequences as lists of (offset, tokens), every remainder placed once and whole."""
    held = {}
    for length, n in counts.items():
        for number in range(n):
            pieces = list(plan.find(length, number))
            assert sum(p[0] for p in pieces) == length
            for size, sequence, offset in pieces:
                held.setdefault(sequence, []).append((offset, size))
    return held


def padding(sizes, capacity):
    return sum(capacity - n for n in sizes if n & (n - 1))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=8))
def test_plan_places_every_remainder_once(counts):
    plan = packing.Plan(counts, 32)
    sizes = []
    for pieces in places(plan, counts).values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= 32
        sizes.append(end)
    assert len(sizes) == plan.sequences and padding(sizes, 32) == 0


def test_plan_grows_with_lengths_not_with_rows():
    r = random.Random(5)
    small = {}
    for _ in range(3000):
        length = min(4095, max(1, int(r.lognormvariate(6, 1))))
        small[length] = small.get(length, 0) + 1
    large = {k: 10_000_000 * n for k, n in small.items()}
    plan = packing.Plan(large)
    assert sum(len(firsts) for firsts, _ in plan.ranges.values()) < 40_000
    assert plan.sequences * 4096 >= sum(k * n for k, n in large.items()) > (plan.sequences - 13) * 4096


def tokens_of(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_equal_the_library(odd_rows, prose):
    alphabet = [chr(c) for c in [*range(0x180), 0x301, 0x2019, 0x2028, 0x3000, 0x4E00, 0x1F600, 0xFB01, 0x3A3, 0x130]]
    r = random.Random(3)
    texts = [t or "" for _, t in odd_rows] + [prose(k, 60) for k in range(40)]
    texts += ["It's we're 'll'd 'S", "<|endoftext|> x<|startoftext|>y", "<|EndOfText|>", "ΑΣ ΟΔΟΣ", "x\x1cy\x85w\xa0v u", "'" * 50, "a'sx !!'s ..'t"]
    texts += ["".join(r.choice(alphabet[:0x180] if k % 2 else alphabet) for _ in range(r.randint(1, 60))) for k in range(1000)]
    tokens = packing.Tokens(PATH)
    for got, expected in zip([x for a in range(0, len(texts), 37) for x in tokens.encode(texts[a : a + 37])], tokens_of(texts), strict=True):
        assert got.tolist() == expected.tolist()


def checked(rows, found, capacity):
    """Every id of every row in one piece, sequences without gaps; returns their sizes."""
    texts = sorted(((i is None, i or 0), t or "") for i, t in rows)
    ids = tokens_of([t for _, t in texts])
    left = {}
    for (key, _), own in zip(texts, ids, strict=True):
        left.setdefault(key, []).append(own)
    by, held = {}, {}
    for p in found:
        by.setdefault((p.doc_id is None, p.doc_id or 0), []).append(p)
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by) == set(left)
    for key, pieces in by.items():
        assert sum(p.length for p in pieces) == sum(map(len, left[key]))
        if len(left[key]) == 1:
            end = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == end and p.doc_tokens == len(left[key][0]) and p.ids_crc32 == crc32(left[key][0][end : end + p.length].tobytes())
                end += p.length
    sizes = []
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        sizes.append(end)
    assert max(sizes) <= capacity
    return sizes


def test_packed(spark, odd_rows, prose):
    r = random.Random(9)
    rows = [*odd_rows, (4, "one"), *[(100 + k, prose(k, r.choice([1, 5, 80, 300, 2000]))) for k in range(150)], *[(1000 + k, prose(7, 50)) for k in range(100)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("part", F.lit("x")).repartition(5)
    for capacity in (4096, 64):
        sizes = checked(rows, packing.packed(docs, PATH, capacity).collect(), capacity)
        assert padding(sizes, capacity) == 0
    assert packing.packed(docs.limit(0), PATH).count() == 0
    null = packing.packed(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).collect()
    assert [tuple(x) for x in null] == [(1, 0, 1, crc32(b"\x02\0\0\0"), 1, 0, 0)]
