"""Queries on filling containers (problem 6) and mixing sources (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.mixing import mix_sources
from placeloom.llm.packing import pack_documents
from placeloom.llm.tokens import with_tokens
from placeloom.session import cut, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut(with_tokens(docs.repartition(max(12, docs.rdd.getNumPartitions()), "doc_id"), ["doc_id", "source"], "text"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_sized(spark, sf_dir), table(spark, sf_dir, "containers"), "doc_id", "tokens", "container_kind", "capacity_tokens")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, container, doc_id, piece, pieces, first_token, tokens): every document's place."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, capacity, containers, tokens, filled): how full the containers are."""
    caps = table(spark, sf_dir, "containers").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity"))
    full = _packed(spark, sf_dir).groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"))
    by_kind = full.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return by_kind.join(F.broadcast(caps), "container_kind").select("container_kind", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens", "recipe", "target_share", "max_repeats")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recipe, source, doc_id, tokens, copies): the documents of every recipe."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recipe, source, target_share, actual_share, ...): what every source gives to every recipe."""
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares}
