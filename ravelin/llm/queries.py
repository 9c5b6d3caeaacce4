"""Queries over the synthetic tables, one per operator, and their SQL where SQL can express them.

Every query works on its whole table with the operator's production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, decontaminate, html_extract, imatch, merkle, neardup, packing, quality, search, toxicity, url_reputation, warc
from ._common import remainder, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_IDS = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = brown.fit(docs, brown.training_rows())
    return brown.score(model, docs, {"doc_id": F.col("doc_id"), "held_out": remainder("doc_id", 7) == 2})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") != F.col("class_id")).alias("is_duplicate"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT *, CASE WHEN n >= {warc.LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
      CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), quality.training_rows())
    scored = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), quality.score(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    full = _table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("x")).select("doc_id", "x.ids", "x.decoded")
    return full.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.training_rows())
    scored = docs.select("doc_id", "lang", (remainder("doc_id", 3) == 1).alias("held_out"), toxicity.score(model, F.col("text"), spark).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), toxicity.flag(model, F.col("score"), F.col("lang")).alias("toxic"))


#: (verdict, host, path prefix).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: A page shows the document whose number ends its path.
SHOWN = "/([0-9]{1,18})(?:/|[.]html)?$"


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the label of the document that it shows: bad if of low quality or toxic."""
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_reputation.host_and_path(F.col("url"))[1], SHOWN, 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    return url_reputation.verdicts(pages, shown.join(labels, "doc_id").select("page_id", "bad"), URL_RULES)


OP10_OUTCOMES = f"""SELECT page_id AS i, (quality = 0 OR toxic = 1)::INT AS bad
  FROM (SELECT page_id, nullif(regexp_extract(path, '{SHOWN}', 1), '')::BIGINT AS doc_id FROM parts) JOIN labels USING (doc_id)"""


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_IDS))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table audited against its own manifest, after n_chars of one row in seven has grown by 1."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0  # not so for a null id, which has no digits
    grown = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.audit(merkle.manifest(_table(spark, sf_dir, "documents"), {"n_chars": grown}))


#: crc32 of the id's digits, bit by bit: -1 stands for a shift.
OP13_TAMPERED = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for d in string_split(doc_id::VARCHAR, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 7 = 0"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_brown_lm, op2_decontaminate, op3_imatch, op4_order_minhash, op5_warc, op6_html_extract, op7_quality, op8_bpe, op9_toxicity, op10_url_reputation, op11_block_max_wand, op12_packing, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_imatch": imatch.oracle(), "op5_warc": OP5_SQL, "op10_url_reputation": url_reputation.oracle(URL_RULES, OP10_OUTCOMES), "op11_block_max_wand": search.oracle(), "op13_merkle": merkle.oracle(OP13_TAMPERED)}
