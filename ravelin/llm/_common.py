"""Shared plumbing of the training-data operators.

Intermediate tables (``work_path``, ``written``) go to the folder that the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_path, written

__all__ = ["BATCH_ROWS", "forget", "free_name", "payload", "remainder", "tune", "work_path", "written"]

#: Rows handed to Python at once; long texts make large batches otherwise.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def forget(table: DataFrame) -> None:
    """Delete a written table when all that reads it has been written itself."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def payload(text: str):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def remainder(key: str, modulus: int):
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
