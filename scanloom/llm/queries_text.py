"""Queries of problems 8, 9 and 10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import leaks, tokenize, truncation
from scanloom.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents come back from their ids exactly (null as empty), and the tokens of all."""
    documents = table(spark, d, "documents")
    back = tokenize.decode(tokenize.encode(documents, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    compared = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was")).join(back.select("doc_id", F.sha2("decoded", 256).alias("now"), "token_count"), "doc_id")
    return compared.agg(F.count("*").alias("document_count"), F.count_if(F.col("was") == F.col("now")).alias("exact"), F.sum("token_count").alias("tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("document_count"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_roundtrip, p9_found, p9_items, p10_found, p10_sources)}
SQL: dict[str, str] = {}
