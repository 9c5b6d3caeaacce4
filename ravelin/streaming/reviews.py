"""The review counts as streaming queries: the same aggregates, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_year


def review_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Review JSON lines of a folder as a stream."""
    return spark.readStream.schema("user_id string, business_id string, date string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Rows per key so far, for update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def running_totals(stream: DataFrame, year: str = "2018") -> DataFrame:
    """Total and total of a year so far."""
    return stream.groupBy().agg(F.count("*").alias("n_review"), F.count_if(in_year(F.col("date"), year)).alias("n_review_year"))
