"""Queries on points near other points or regions (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.spatial import points_in_regions, points_near_points, post_point
from placeloom.session import table

NEAR_M = 5_000.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, relation, geonameid): the adm1 region around each post's point and the places within 5 km."""
    posts = table(spark, sf_dir, "posts").select("post_id", post_point(F.col("coordinates"), F.col("bbox")).alias("at"))
    points = posts.where("at is not null and post_id is not null").select("post_id", "at.lon", "at.lat").dropDuplicates(["post_id"])
    inside = points_in_regions(points, table(spark, sf_dir, "adm1"), "post_id", "lon", "lat", "geonameid", "rings")
    places = table(spark, sf_dir, "geonames").where("feature_class = 'P'")
    near = points_near_points(points, places, "post_id", "lon", "lat", "geonameid", "longitude", "latitude", NEAR_M)
    return inside.select("post_id", F.lit("adm1").alias("relation"), "geonameid").unionByName(near.select("post_id", F.lit("near").alias("relation"), "geonameid"))


P1_SQL = """
WITH pt AS (
  SELECT DISTINCT post_id,
    CASE WHEN ok THEN coordinates.lon WHEN mid > 180 THEN mid - 360 ELSE mid END AS x,
    CASE WHEN ok THEN coordinates.lat ELSE (bbox[2] + bbox[4]) / 2 END AS y
  FROM (SELECT post_id, coordinates, bbox,
          coalesce(coordinates.lon BETWEEN -180 AND 180 AND coordinates.lat BETWEEN -90 AND 90
                   AND NOT (coordinates.lon = 0 AND coordinates.lat = 0), false) AS ok,
          (bbox[1] + bbox[3] + CASE WHEN bbox[1] > bbox[3] THEN 360 ELSE 0 END) / 2 AS mid
        FROM posts)
), ring AS (SELECT geonameid, unnest(rings) AS r FROM adm1),
vertex AS (SELECT geonameid, r, unnest(range(1, len(r) + 1)) AS i FROM ring),
edge AS (
  SELECT geonameid, r[i].lon AS x1, r[i].lat AS y1, r[1 + i % len(r)].lon AS x2, r[1 + i % len(r)].lat AS y2 FROM vertex
), box AS (SELECT geonameid, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edge GROUP BY 1)
SELECT post_id, 'adm1' AS relation, b.geonameid
FROM pt JOIN box b ON x BETWEEN w AND e AND y BETWEEN s AND n JOIN edge g ON g.geonameid = b.geonameid
GROUP BY post_id, x, y, b.geonameid
HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1
UNION ALL
SELECT post_id, 'near' AS relation, geonameid FROM pt JOIN geonames ON latitude BETWEEN y - 0.05 AND y + 0.05
WHERE feature_class = 'P' AND 2 * 6371009.0 * asin(sqrt(least(1, pow(sin(radians(latitude - y) / 2), 2)
  + cos(radians(y)) * cos(radians(latitude)) * pow(sin(radians(longitude - x) / 2), 2)))) < 5000
"""

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
