"""Queries on truncated documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.truncation import find_truncated
from placeloom.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents whose text was cut off before its end."""
    return find_truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("truncated").select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, truncated, share): how often each source truncates."""
    told = find_truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    counts = told.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return counts.withColumn("share", F.col("truncated") / F.col("documents"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}
