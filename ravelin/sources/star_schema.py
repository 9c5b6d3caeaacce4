"""Reviews, businesses, baskets and ratings as views of the star-schema test tables.

The whole tables are used: a line item is a review of its part by its customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

YEAR = "1998"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id, date, stars`` and the order of writing ``order_id, line``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("business_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("business_id"), F.col("p_brand").alias("city"))


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id``: order and brand of each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("user_id"), F.col("p_brand").alias("business_id"))


def type_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id``: part type and order of each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("user_id"), F.col("l_orderkey").cast("string").alias("business_id"))


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id``: order and size of the part of each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("user_id"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("business_id"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id``: pairs of words that follow each other in a document, and the document."""
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("business_id"), words.alias("w"))
    both = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    return docs.select(F.explode(F.filter(both, lambda x: F.instr(x, " ") > 0)).alias("user_id"), "business_id")


def brand_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, business_id``: customer and brand of each line item."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("business_id"), "p_brand")
    return reviews(spark, sf_dir).select("user_id", "business_id").join(parts, "business_id").select("user_id", F.col("p_brand").alias("business_id"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, stars`` with the order of writing, repeated pairs included."""
    return reviews(spark, sf_dir).withColumnRenamed("business_id", "item_id")


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, stars`` with the order of writing: customer, brand, and a discount beside a price of a hundred thousand."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("p_brand").alias("item_id"), (F.lit(1e5) + F.col("l_discount")).alias("stars"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"))


def volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) ``user_id, item_id, stars``: the volume of a line of a part, from 1 to 5, by its quantity; each part's last line is a test row."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    last = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")))
    stars = 1 + 4 * F.col("l_quantity") * F.col("p_size") / 2500
    found = rows.select(F.col("l_quantity").cast("int").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id"), stars.alias("stars"), last.alias("at"))
    return found.where("at > 1").drop("at").distinct(), found.where("at = 1").drop("at")
