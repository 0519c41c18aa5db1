"""Queries on near-duplicate posts (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm.neardup import near_duplicates
from placeloom.session import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, post_id): posts repeated within a day with small changes, by group."""
    return near_duplicates(spread(table(spark, sf_dir, "posts").select("post_id", "posted_at", "text")), "post_id", "posted_at", "text")


QUERIES = {"p2_found": p2_found}
