"""Queries on author locations and the places they mean (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.canonical import map_values
from placeloom.operators.spatial import points_in_regions
from placeloom.session import broadcast_if_small, cut, table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and codes of the places of geonames, and the ISO codes of countries."""
    geo = table(spark, sf_dir, "geonames").select(F.col("geonameid").alias("id"), "full_name", (F.col("feature_class") == "A").alias("is_area"), "population", F.array_compact(F.array("geonameid", "country_geonameid", "adm1_geonameid")).alias("inside"))
    other = table(spark, sf_dir, "alternate_names").where("isolanguage is null or isolanguage not in ('link', 'post')")
    names = geo.select(F.col("full_name").alias("label"), F.lit(0).alias("kind"), "id").unionByName(other.select(F.col("full_name").alias("label"), F.when(F.col("isolanguage") == "abbr", 1).otherwise(0).alias("kind"), F.col("geonameid").alias("id")))
    lost = table(spark, sf_dir, "geonames").where("adm1_geonameid is null").select(F.col("geonameid").alias("id"), "longitude", "latitude")
    found = points_in_regions(lost, table(spark, sf_dir, "adm1"), "id", "longitude", "latitude", "geonameid", "rings").groupBy("id").agg(F.collect_set("geonameid").alias("around"))
    geo = geo.join(found, "id", "left").withColumn("inside", F.array_distinct(F.concat("inside", F.coalesce("around", F.array().cast("array<int>"))))).drop("around")
    entries = names.join(geo.drop("full_name"), "id")
    countries = table(spark, sf_dir, "countries")
    codes = [countries.select(F.col(c).alias("label"), F.lit(kind).alias("kind"), F.col("geonameid").alias("id"), F.lit(True).alias("is_area"), F.lit(0).cast("long").alias("population"), F.array("geonameid").alias("inside")) for c, kind in (("iso2", 2), ("iso3", 2), ("name", 2))]
    for c in codes:
        entries = entries.unionByName(c)
    return entries


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, geonameid): every distinct author location and what it means, -1 where nothing listed."""
    posts = table(spark, sf_dir, "posts").select(F.col("author.location").alias("value"))
    got = map_values(posts, "value", _entries(spark, sf_dir))
    return got.select("value", F.coalesce("id", F.lit(-1)).alias("geonameid"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, geonameid): the place each post's author location means, -1 where none."""
    meant = broadcast_if_small(cut(p3_values(spark, sf_dir)))
    posts = table(spark, sf_dir, "posts").select("post_id", F.col("author.location").alias("value")).where("value is not null")
    return posts.join(meant, "value").select("post_id", "geonameid").distinct()


QUERIES = {"p3_found": p3_found, "p3_values": p3_values}
