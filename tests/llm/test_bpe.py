import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from ravelin.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_equals_the_library_on_random_strings(codec, library):
    r = random.Random(3)
    bits = ["a", "b", "the", " ", "  ", "\x1c", "\x1d", "\x85", "\xa0", "\u2003", "\n", "\t", "é", "日", "1", "23", "!", "'s", "\u200b", "\U0001f600", "\ufeff", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert codec.encode(s).tolist() == library.encode_ordinary(s)
        assert codec.decode(codec.encode(s).tolist()) == s.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_000, "ab" * 7_000, "the" * 5_000, "日本" * 3_000, "!?" * 4_000])
def test_very_long_pretokens(codec, library, text):
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(codec, monkeypatch):
    small = bpe.Codec(codec.ranks, P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert small.encode(text).tolist() == codec.encode(text).tolist()


def test_columns(spark, library, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = df.select("doc_id", "text", "ids", bpe.encode(F.col("text"), PATH, P.PATTERN).alias("x"))
    out = out.withColumn("back", bpe.decode(F.col("x"), PATH, P.PATTERN)).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        assert r.x == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    both = df.select("text", bpe.round_trip(F.col("text"), PATH, P.PATTERN).alias("x")).select("text", "x.*").collect()
    assert all(r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in both)
    assert df.limit(0).select(bpe.encode(F.col("text"), PATH, P.PATTERN)).count() == 0
    null = spark.range(1).select(bpe.decode(F.lit(None).cast("array<int>"), PATH, P.PATTERN).alias("b")).first()
    assert bytes(null.b) == b""
