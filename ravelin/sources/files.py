"""Readers with explicit schemas and the report writers.

JSON is read in FAILFAST mode, and a row without a required key raises when it
is read; extra fields are ignored.  CSV follows the usual quoting rules.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import report


def _json(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON lines; only the fields of the schema are parsed."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"missing {name}"))))
    return df


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, business_id, date`` of review JSON lines."""
    return _json(spark, path, "user_id string, business_id string, date string", ["user_id", "business_id", "date"])


def review_businesses(spark: SparkSession, path: str) -> DataFrame:
    """``business_id`` of review JSON lines (top-level field)."""
    return _json(spark, path, "business_id string", ["business_id"])


def review_stars(spark: SparkSession, path: str) -> DataFrame:
    """``business_id, stars`` of review JSON lines; stars may be null."""
    return _json(spark, path, "business_id string, stars double", ["business_id"])


#: JSON's tokens but for commas: strings (a key with its colon), brackets, other values.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[\[\]{}]|[^\s",:\[\]{}]++'


def first_at_any_depth(spark: SparkSession, path: str, key: str = "business_id") -> DataFrame:
    """The value of the first ``key`` of each JSON line, in document order and however deep; the rest of the line is not looked at.

    Raises for a line without the key, or whose first one is not a string.  Tokens
    are taken from the text: a parsed object no longer has the order of its keys.
    """
    tokens = F.regexp_extract_all("value", F.lit(JSON_TOKEN), F.lit(0))
    lines = spark.read.text(path).select(tokens.alias("tokens"))
    keys = F.transform("tokens", lambda t: t.rlike(f'^"{re.escape(key)}"\\s*:$'))
    found = lines.withColumn("at", F.array_position(keys, True)).withColumn("token", F.try_element_at("tokens", (F.col("at") + 1).cast("int")))
    value = F.from_json(F.concat(F.lit("["), "token", F.lit("]")), "array<string>")[0]
    missing, other = F.raise_error(F.lit(f"missing {key}")), F.raise_error(F.lit(f"{key} is not a string"))
    return found.select(F.when(F.col("at") == 0, missing).when(~F.coalesce("token", F.lit("")).startswith('"'), other).otherwise(value).alias(key))


def businesses(spark: SparkSession, path: str) -> DataFrame:
    """``business_id, city`` of business JSON lines; city may be null."""
    return _json(spark, path, "business_id string, city string", ["business_id"])


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, business_id`` of a headered CSV; further columns are ignored."""
    return spark.read.csv(path, header=True).selectExpr("user_id", "business_id")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, business_id, stars`` of a headered CSV of exactly these columns."""
    schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("business_id", T.StringType()), T.StructField("stars", T.DoubleType())])
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def spread(df: DataFrame, partitions: int = 2) -> DataFrame:
    """The input dealt anew over a number of partitions."""
    return df.repartition(partitions)


def document(row: DataFrame) -> str:
    """A one-row DataFrame as one JSON document; arrays of structs become lists of lists, like ``[id, count]``."""
    line = row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).first()
    fields = json.loads(line[0]) if line else {}
    return json.dumps({k: [list(x.values()) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in fields.items()})


def write_document(row: DataFrame, path: str) -> None:
    """``document`` in a local file."""
    Path(path).write_text(document(row))


def write_city_stars(cities: DataFrame, path: str) -> None:
    """``city,stars`` as one CSV file with header, in the given order."""
    cities.select("city", "stars").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_city_stars_text(cities: DataFrame, path: str) -> None:
    """``city,stars`` lines as text files."""
    cities.select(F.concat_ws(",", F.coalesce("city", F.lit("")), F.col("stars").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("user_id", "business_id", "prediction").write.mode("overwrite").csv(path, header=True)


def write_similar(found: DataFrame, path: str) -> None:
    found.select("business_id_1", "business_id_2", "similarity").orderBy("business_id_1", "business_id_2").write.mode("overwrite").csv(path, header=True)


def itemset_pieces(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``section, k, items, value``: the report's pieces, one a set, in the order of the first three.

    Two sections with one line per size; sets sorted, rendered like Python tuples,
    singletons as ('x').
    """
    sets = candidates.select(F.lit(1).alias("section"), "k", "items").unionByName(frequent.select(F.lit(2).alias("section"), "k", "items"))
    quoted = F.transform("items", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    first = sets.groupBy("section", "k").agg(F.min("items").alias("first"))
    before = F.when(F.col("items") == F.col("first"), "\n\n").otherwise(",")
    shown = sets.join(first, ["section", "k"]).select("section", "k", "items", F.concat(before, F.lit("("), F.array_join(quoted, ", "), F.lit(")")).alias("value"))
    heads = [(1, 0, [], "Candidates:"), (2, 0, [], "\n\nFrequent Itemsets:"), (3, 0, [], "\n")]
    return shown.unionByName(candidates.sparkSession.createDataFrame(heads, "section int, k int, items array<string>, value string"))


PIECE_ORDER = ["section", "k", "items"]


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> str:
    """The report as text, for short ones."""
    return "".join(r.value for r in itemset_pieces(candidates, frequent).orderBy(*PIECE_ORDER).toLocalIterator())


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The report as one file, written by all tasks."""
    report.write(itemset_pieces(candidates, frequent), PIECE_ORDER, path)
