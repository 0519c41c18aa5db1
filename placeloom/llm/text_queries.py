"""Queries on the plain form (problem 4) and the languages (problem 5) of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.language import LanguageModel, fit_languages, label_languages, label_segments, language_code
from placeloom.llm.plain import plain_forms
from placeloom.llm.words import words
from placeloom.session import spread, table

LEAST_WORDS = 6  #: shorter posts are no case of p5_found


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spread(table(spark, sf_dir, "posts")).select(F.lit("post").alias("record_kind"), F.col("post_id").alias("record_id"), "text")
    names = table(spark, sf_dir, "alternate_names").select(F.lit("name").alias("record_kind"), F.col("alternatenameid").cast("string").alias("record_id"), F.col("alternate_name").alias("text"))
    return posts.unionByName(names)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id): texts and names that differ from their plain form."""
    changed = plain_forms(_records(spark, sf_dir), ["record_kind", "record_id"], "text", only_changed=True)
    return changed.select("record_kind", "record_id").distinct()


def p4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, plain): every text and name in its plain form."""
    return plain_forms(_records(spark, sf_dir), ["record_kind", "record_id"], "text").select("record_kind", "record_id", "plain")


def _posts_and_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, LanguageModel]:
    posts = spread(table(spark, sf_dir, "posts").select("post_id", "text", "lang"))
    return posts, fit_languages(posts, "text", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, lang): the languages of posts whose label is missing or wrong or that hold two languages."""
    posts, model = _posts_and_model(spark, sf_dir)
    enough = posts.select("post_id", "text", language_code(F.col("lang")).alias("label")).where(F.size(words(F.col("text"))) >= LEAST_WORDS)
    got = label_languages(enough, ["post_id", "label"], "text", model).where(F.size("segments") > 0)
    wrong = F.col("label").isNull() | (F.size("segments") > 1) | (F.col("label") != F.col("segments")[0]["lang"])
    return got.where(wrong).select("post_id", F.explode("segments.lang").alias("lang")).distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, lang, confidence, first, last): every run of sentences of one language in every post, short
    posts too; first and last number the sentences from 0. lang and confidence are null where none can be told."""
    posts, model = _posts_and_model(spark, sf_dir)
    return label_segments(posts, ["post_id"], "text", model).select("post_id", F.inline("segments")).dropDuplicates(["post_id", "first"])


QUERIES = {"p4_found": p4_found, "p4_plain": p4_plain, "p5_found": p5_found, "p5_segments": p5_segments}
