"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's documents.  A filtering stage keeps
rows whole, with the columns it was given; only the last stage adds columns.
Null or empty texts are ordinary documents: what a stage's operator says of the
empty text decides about them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, decontaminate, neardup, quality, toxicity
from ravelin.llm._common import tune, written
from ravelin.llm.queries import RANKS

#: Documents less likely than this to be of quality 1 are rejected.
LEAST_QUALITY = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score reaches their language's threshold go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir), toxicity.training_rows())
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.where(~toxicity.flag(model, toxicity.score(model, F.col("text"), spark), lang))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents that score below LEAST_QUALITY go."""
    model = quality.fit(docs, _labels(spark, sf_dir), quality.training_rows())
    return docs.where(quality.score(model, F.col("text"), spark) >= LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order MinHash: one document of each class stays, that with the smallest id."""
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each document, and whether they decode to its text."""
    tune(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), bpe.round_trip(F.col("text"), path, pattern).alias("x"))
    return coded.select("doc_id", F.size("x.ids").cast("long").alias("n_tokens"), "x.ids", (F.col("x.decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_level_bpe", tokenise),
]

#: Trained models, sketches and alignment are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
