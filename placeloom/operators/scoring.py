"""Scores of candidates from a post's metadata and its other names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.functions.predicates import home_value, is_family, matches_offset, matches_point, side
from placeloom.operators.spatial import points_in_regions
from placeloom.session import broadcast_if_small


def areas_of_points(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(post_id, areas): the areas around each post's point."""
    around = points_in_regions(points, areas, "post_id", "lon", "lat", "geonameid", "rings")
    return around.groupBy("post_id").agg(F.array_sort(F.collect_set("geonameid")).alias("areas"))


def bbox_points(posts: DataFrame) -> DataFrame:
    """(post_id, lon, lat): plain centres of the boxes of posts without coordinates."""
    b = F.col("bbox")
    return posts.where(F.col("lon").isNull() & F.col("bbox").isNotNull()).select("post_id", ((b[0] + b[2]) / 2).alias("lon"), ((b[1] + b[3]) / 2).alias("lat"))


def score_candidates(found: DataFrame, posts: DataFrame, areas: DataFrame, zones: DataFrame, area_zones: DataFrame, homes: DataFrame, continents: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Candidates with user_id, posted_at and the scores s_coordinates, s_home, s_bbox, s_family, s_offset.

    areas: (geonameid, rings) of countries and continents; zones: (post_id, zones); area_zones:
    (geonameid, zones); homes: main_home(); continents: (geonameid of a country, continents).
    """
    boxes = bbox_points(posts)
    points = posts.where("lon is not null").select("post_id", "lon", "lat").unionByName(boxes)
    here = posts.select("post_id", "user_id", "posted_at", "home", F.col("lon").isNotNull().alias("_exact")).join(points, "post_id", "left").join(areas_of_points(points, areas), "post_id", "left").join(zones, "post_id", "left")
    rows = found.join(here, "post_id").join(broadcast_if_small(homes), "home", "left")
    rows = rows.join(broadcast_if_small(area_zones.select("geonameid", F.col("zones").alias("_area_zones"))), "geonameid", "left")
    rows = rows.join(broadcast_if_small(continents.select(F.col("geonameid").alias("country_geonameid"), F.col("continents").alias("continents"))), "country_geonameid", "left")
    none = F.array().cast("array<int>")
    at = matches_point(side(""), F.col("lon"), F.col("lat"), F.coalesce(F.col("areas"), none), settings)
    family = is_family(side(""), side("home_"), F.col("toponym"), F.col("home_toponym"), settings=settings)
    rows = rows.withColumns(
        {
            "s_coordinates": F.when(F.col("_exact") & at, settings.score_coordinates).otherwise(0.0).cast("double"),
            "s_bbox": F.when(~F.col("_exact") & at, settings.score_bbox).otherwise(0.0).cast("double"),
            "s_offset": F.when(matches_offset(side(""), F.col("zones"), F.col("_area_zones")), settings.score_offset).otherwise(0.0).cast("double"),
            "s_home": F.when(F.col("home_geonameid").isNotNull() & (home_value(side(""), side("home_"), family) > 0), settings.score_home).otherwise(0.0).cast("double"),
        }
    )
    fields = ["toponym", "geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude", "continents"]
    beside = F.collect_list(F.struct(*fields)).over(Window.partitionBy("post_id"))
    kin = F.exists("_beside", lambda x: (x["toponym"] != F.col("toponym")) & is_family(side(""), lambda f: x[f], F.col("toponym"), x["toponym"], continents=lambda s: s("continents"), siblings=False, by_population=True, settings=settings))
    rows = rows.withColumn("_beside", beside).withColumn("s_family", F.when(kin, settings.score_family).otherwise(0.0).cast("double"))
    return rows.select(
        "post_id", "user_id", "posted_at", "lang", "toponym", "original", "cut", "geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude", "languages", "abbreviations",
        "s_coordinates", "s_home", "s_bbox", "s_family", "s_offset",
    )
