"""Queries for the engine's own operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.functions import text as tx
from placeloom.functions.dates import daterange
from placeloom.operators import candidates as ca
from placeloom.operators import gazetteer as gz
from placeloom.operators import resolve as rs
from placeloom.operators import scoring as sc
from placeloom.operators.search import find_posts, has_location
from placeloom.operators.similar_posts import earliest_of_text, without_near_duplicates
from placeloom.operators.spatial import points_near_points
from placeloom.plans.binding import LAST_STEP, START, Tables
from placeloom.plans.sqlparts import distance, with_parts

AS_WRITTEN = Settings(family_mode="as_written")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_parts(sql, *needs) if needs else sql
        return f

    return keep


def joined(c: str) -> F.Column:
    return F.array_join(F.array_sort(c), "|")


# --- text ---


@query("op_x1_clean_text", "SELECT post_id, clean AS clean, lower(clean) AS lowered FROM cleaned", "cleaned")
def _(t: Tables) -> DataFrame:
    clean = tx.clean_text(F.col("text"), lower=False)
    return t.posts.select("post_id", clean.alias("clean"), F.lower(clean).alias("lowered"))


@query("op_x4_unescape_html", "SELECT DISTINCT post_id, replace(text, '&amp;', '&') AS plain FROM posts")
def _(t: Tables) -> DataFrame:
    return t.posts.select("post_id", tx.unescape_html(F.col("text")).alias("plain"))


@query("op_x7_tokenize", "SELECT post_id, array_to_string(t, '|') AS tokens FROM token", "token")
def _(t: Tables) -> DataFrame:
    return t.posts.select("post_id", F.array_join(tx.tokenize(tx.clean_text(F.col("text"), lower=False), remove_punctuation=True), "|").alias("tokens"))


@query("op_x8_ngrams", "SELECT post_id, array_to_string(list_sort(grams), '|') AS grams FROM gram_list", "gram_list")
def _(t: Tables) -> DataFrame:
    tokens = tx.tokenize(tx.clean_text(F.col("text"), lower=False), remove_punctuation=True)
    rows = t.posts.select("post_id", F.explode(F.array(tokens)).alias("t"))
    return rows.select("post_id", tx.ngrams(F.col("t"), 1, DEFAULT.max_ngram, without=r"\p{N}").alias("g")).select("post_id", joined("g").alias("grams"))


@query("op_x10_strip_tags", "SELECT post_id, gram, cut FROM gram WHERE cut", "gram")
def _(t: Tables) -> DataFrame:
    return t.grams().where("cut").select("post_id", "gram", "cut")


@query("op_x12_case_tests", "SELECT post_id, regexp_matches(clean, '^\\p{Lu}') AS starts_upper, NOT regexp_matches(clean, '(^| )[^\\p{Lu}]') AS all_upper, regexp_matches(clean, '\\p{Lu}') AND NOT regexp_matches(clean, '(^|[^\\p{L}])\\p{Ll}') AND NOT regexp_matches(clean, '\\p{L}\\p{Lu}') AS title FROM cleaned", "cleaned")
def _(t: Tables) -> DataFrame:
    c = F.col("c")
    return t.posts.select("post_id", tx.clean_text(F.col("text"), lower=False).alias("c")).select("post_id", tx.starts_upper(c).alias("starts_upper"), tx.all_parts_upper(c).alias("all_upper"), tx.is_title(c).alias("title"))


@query("op_x13_first_words", "SELECT post_id, array_to_string(list_sort(first_words), '|') AS words FROM firsts", "firsts")
def _(t: Tables) -> DataFrame:
    return t.posts.select("post_id", tx.sentence_first_words(tx.clean_text(F.col("text"), lower=False)).alias("w")).select("post_id", joined("w").alias("words"))


@query("op_x16_dead_helpers")
def _(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.posts.select("post_id", tx.to_ascii(x).alias("ascii"), tx.reduce_repeats(x).alias("reduced"), tx.capitals_to_title(x).alias("titled"), tx.single_punctuation(x).alias("single"), tx.clean_end_marks(x).alias("ends"))


@query("op_s16_corpus_ngrams", "SELECT gram, count(*) AS posts FROM (SELECT g.post_id, unnest(grams) AS gram FROM gram_list g JOIN base USING (post_id) WHERE g.lang = 'nl' AND NOT retweet) GROUP BY 1 HAVING count(*) > 1", "gram_list", "base")
def _(t: Tables) -> DataFrame:
    tokens = tx.tokenize(tx.clean_text(F.col("text"), lower=False), remove_punctuation=True)
    rows = t.posts.where("lang = 'nl' and not retweet").select(F.explode(F.array(tokens)).alias("t"))
    grams = rows.select(F.explode(tx.ngrams(F.col("t"), 1, DEFAULT.max_ngram, without=r"\p{N}")).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("posts")).where("posts > 1")


@query("op_s16_all_ngrams", "SELECT lang, gram, count(*) AS posts FROM (SELECT g.post_id, g.lang, unnest(grams) AS gram FROM gram_list g JOIN base USING (post_id) WHERE NOT coalesce(retweet, false)) GROUP BY 1, 2", "gram_list", "base")
def _(t: Tables) -> DataFrame:
    """The n-grams of every language, those of one post too."""
    tokens = tx.tokenize(tx.clean_text(F.col("text"), lower=False), remove_punctuation=True)
    rows = t.posts.where("not coalesce(retweet, false)").select("lang", F.explode(F.array(tokens)).alias("t"))
    grams = rows.select("lang", F.explode(tx.ngrams(F.col("t"), 1, DEFAULT.max_ngram, without=r"\p{N}")).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.count("*").alias("posts"))


# --- gazetteer ---


@query("op_f8_features", "SELECT geonameid, feature_code, is_adm1 FROM kept", "kept")
def _(t: Tables) -> DataFrame:
    kept = gz.keep_features(t.geonames, t.adm1)
    return kept.join(t.adm1.select(F.col("geonameid"), F.lit(True).alias("a")), "geonameid", "left").select("geonameid", "feature_code", F.coalesce("a", F.lit(False)).alias("is_adm1"))


@query("op_f9_alternates", "SELECT alternatenameid, geonameid, isolanguage, alternate_name FROM alternate", "alternate")
def _(t: Tables) -> DataFrame:
    return gz.keep_alternates(t.alternates, gz.keep_features(t.geonames, t.adm1)).select("alternatenameid", "geonameid", "isolanguage", "alternate_name")


@query("op_f13_location_type", "SELECT geonameid, type FROM (SELECT DISTINCT geonameid, type FROM gaz)", "gaz")
def _(t: Tables) -> DataFrame:
    return t.gazetteer().select("geonameid", "type").distinct()


@query("op_u1_unique_names", "SELECT name FROM geonames UNION SELECT alternate_name FROM alternate_names")
def _(t: Tables) -> DataFrame:
    return gz.unique_names(t.geonames, t.alternates)


@query("op_j21_new_names", "SELECT name FROM (SELECT name FROM geonames UNION SELECT alternate_name FROM alternate_names) WHERE name NOT IN (SELECT name FROM geonames WHERE population > 50000)")
def _(t: Tables) -> DataFrame:
    return gz.new_names(gz.unique_names(t.geonames, t.alternates), t.geonames.where("population > 50000"))


@query("op_a6_translations", "SELECT geonameid, count(*) AS translations FROM alternate GROUP BY 1", "alternate")
def _(t: Tables) -> DataFrame:
    return gz.translations(gz.keep_alternates(t.alternates, gz.keep_features(t.geonames, t.adm1)))


@query("op_a7_gazetteer", "SELECT name, geonameid, type, population, translations, country_geonameid, adm1_geonameid, time_zone, array_to_string(languages, '|') AS languages, array_to_string(abbreviations, '|') AS abbreviations FROM gaz", "gaz")
def _(t: Tables) -> DataFrame:
    return t.gazetteer().select("name", "geonameid", "type", "population", "translations", "country_geonameid", "adm1_geonameid", "time_zone", joined("languages").alias("languages"), joined("abbreviations").alias("abbreviations"))


@query("op_a8_documents", "SELECT name, count(*) AS places, string_agg(geonameid::VARCHAR, '|' ORDER BY geonameid) AS ids FROM gaz GROUP BY 1", "gaz")
def _(t: Tables) -> DataFrame:
    return gz.gazetteer_documents(t.gazetteer()).select("name", F.size("locations").cast("long").alias("places"), F.array_join(F.transform("locations", lambda x: x["geonameid"].cast("string")), "|").alias("ids"))


@query("op_a13_admin_names", "SELECT name, geonameid, type, population, country_geonameid, array_to_string(abbreviations, '|') AS abbreviations FROM admin", "admin")
def _(t: Tables) -> DataFrame:
    return t.admin().select("name", "geonameid", "type", "population", "country_geonameid", joined("abbreviations").alias("abbreviations"))


@query("op_a14_zones_per_country", "SELECT geonameid, array_to_string(area_zones, '|') AS zones FROM area_zone", "area_zone")
def _(t: Tables) -> DataFrame:
    return t.area_zones().select("geonameid", joined("zones").alias("zones"))


@query("op_a11_merge_regions", "SELECT geonameid, count(*) AS parts, sum(len(rings)) AS rings FROM (SELECT geonameid, rings FROM countries UNION ALL SELECT country_geonameid, a.rings FROM adm1 a JOIN geonames USING (geonameid)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    own = t.adm1.join(t.geonames.select("geonameid", "country_geonameid"), "geonameid").select((-F.col("country_geonameid")).alias("geonameid"), "rings")
    parts = t.countries.select("geonameid", "rings").unionByName(own)
    counts = parts.groupBy(F.abs("geonameid").alias("geonameid")).agg(F.count("*").alias("parts"))
    return gz.merge_regions(parts).join(counts, "geonameid").select("geonameid", "parts", F.size("rings").cast("long").alias("rings"))


_ADM1_EDGE = "edge AS (SELECT geonameid AS region, r[i].lon AS x1, r[i].lat AS y1, r[1 + i % len(r)].lon AS x2, r[1 + i % len(r)].lat AS y2 FROM (SELECT geonameid, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT geonameid, unnest(rings) AS r FROM adm1)))"
_IN_EDGE = "count(*) FILTER (WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2 = 1"


@query(
    "op_j5_region_of_place",
    f"WITH {_ADM1_EDGE}, inside AS (SELECT geonameid, region FROM geonames g JOIN edge ON true WHERE feature_class = 'P' GROUP BY geonameid, region, longitude, latitude HAVING {_IN_EDGE}), least AS (SELECT geonameid, min(region) AS region FROM inside GROUP BY 1), "
    "child AS (SELECT geonameid AS adm2, min(adm1_geonameid) AS parent FROM geonames WHERE feature_code = 'PPLA2' AND adm1_geonameid IS NOT NULL GROUP BY 1) SELECT geonameid, coalesce(parent, region) AS region FROM geonames LEFT JOIN least USING (geonameid) LEFT JOIN child ON adm2 = geonameid",
)
def _(t: Tables) -> DataFrame:
    children = t.geonames.where("feature_code = 'PPLA2' and adm1_geonameid is not null").select(F.col("geonameid").alias("adm2"), F.col("adm1_geonameid").alias("adm1_parent"))
    return gz.fill_regions(t.geonames, t.adm1, children).select("geonameid", "region")


_ZONE_AREAS = "zone AS (SELECT c.geonameid, any_value(time_zone) AS name, any_value(c.rings) AS rings FROM countries c JOIN geonames g USING (geonameid) GROUP BY 1)"


@query(
    "op_j6_zone_of_place",
    f"WITH {_ZONE_AREAS}, ring AS (SELECT geonameid AS area, name AS zone, unnest(rings) AS r FROM zone), vertex AS (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM ring), "
    "edge AS (SELECT area, zone, r[i].lon AS x1, r[i].lat AS y1, r[1 + i % len(r)].lon AS x2, r[1 + i % len(r)].lat AS y2 FROM vertex), "
    f"inside AS (SELECT geonameid, zone FROM geonames JOIN edge ON true GROUP BY geonameid, area, zone, longitude, latitude HAVING {_IN_EDGE}) "
    "SELECT geonameid, min(zone) AS zone FROM geonames LEFT JOIN inside USING (geonameid) GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    zones = t.countries.join(t.geonames.select("geonameid", "time_zone"), "geonameid").select(F.col("time_zone").alias("name"), "rings")
    return gz.fill_time_zones(t.geonames, zones).select("geonameid", "zone")


@query("op_j8_zones_of_countries", "SELECT c.geonameid, string_agg(DISTINCT time_zone, '|' ORDER BY time_zone) AS zones FROM geonames g JOIN countries c ON c.geonameid = g.country_geonameid WHERE time_zone IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.geonames.where("time_zone is not null").join(t.countries.select(F.col("geonameid").alias("country_geonameid"), "iso2"), "country_geonameid").select("iso2", F.col("time_zone").alias("name"))
    return gz.zones_per_country(rows, t.countries).select("geonameid", joined("zones").alias("zones"))


@query("op_j10_country_of_code", "SELECT g.geonameid, iso2, c.geonameid AS country_geonameid FROM geonames g LEFT JOIN countries c ON c.geonameid = g.country_geonameid")
def _(t: Tables) -> DataFrame:
    coded = t.geonames.join(t.countries.select(F.col("geonameid").alias("country_geonameid"), F.col("iso2")), "country_geonameid", "left").select("geonameid", "iso2")
    return gz.add_countries(coded, t.countries, "iso2").select("geonameid", "iso2", "country_geonameid")


@query("op_j11_continents", "SELECT geonameid, CASE iso2 WHEN 'KQ' THEN '6255148|6255147' WHEN 'NA' THEN '6255149' ELSE '6255148' END AS continents FROM countries")
def _(t: Tables) -> DataFrame:
    code = F.when(F.col("iso2") == "NA", "NA").otherwise("EU")
    ids = gz.continents_of(code, {"KQ": ["EU", "AS"]}, F.col("iso2"))
    return t.countries.select("geonameid", F.array_join(F.transform(ids, lambda x: x.cast("string")), "|").alias("continents"))


@query("op_t1_common_words", "SELECT lang, word FROM common", "common")
def _(t: Tables) -> DataFrame:
    return t.common()


# --- candidates ---


@query("op_f10_f11_kept_grams", "SELECT post_id, lang, toponym, count(*) AS forms FROM (SELECT DISTINCT post_id, lang, toponym, gram FROM met) GROUP BY 1, 2, 3", "met")
def _(t: Tables) -> DataFrame:
    kept = ca.kept_names(ca.grams_of(t.posts, t.tags, t.settings, t.gazetteer()), t.gazetteer(), gz.country_names(t.admin()), t.common())
    return kept.groupBy("post_id", "lang", "toponym").agg(F.count_distinct("gram").alias("forms"))


@query("op_j1_j2_names", "SELECT post_id, lang, toponym, original, cut, first_word FROM name", "name")
def _(t: Tables) -> DataFrame:
    return t.names()


@query("op_j3_dominated", "SELECT toponym, geonameid, rival_population FROM lost", "lost")
def _(t: Tables) -> DataFrame:
    return ca.dominated(t.gazetteer())


@query("op_f12_candidates", "SELECT post_id, toponym, original, geonameid, type, population FROM candidate", "candidate")
def _(t: Tables) -> DataFrame:
    return t.candidates().select("post_id", "toponym", "original", "geonameid", "type", "population")


# --- predicates and scores ---


@query("op_p7_p9_homes", "SELECT home, toponym, geonameid, type FROM home_place", "home_place")
def _(t: Tables) -> DataFrame:
    return t.homes().select("home", "toponym", "geonameid", "type")


@query("op_p1_p6_scores", "SELECT post_id, toponym, geonameid, s_coordinates, s_home, s_bbox, s_family, s_offset FROM scored", "scored")
def _(t: Tables) -> DataFrame:
    return t.scored().select("post_id", "toponym", "geonameid", "s_coordinates", "s_home", "s_bbox", "s_family", "s_offset")


@query("op_j12_areas_of_posts", "SELECT post_id, array_to_string(areas, '|') AS areas FROM area", "area")
def _(t: Tables) -> DataFrame:
    points = t.posts.where("lon is not null").select("post_id", "lon", "lat").unionByName(sc.bbox_points(t.posts))
    return sc.areas_of_points(points, t.countries).select("post_id", F.array_join("areas", "|").alias("areas"))


@query("op_j13_near_towns", f"SELECT post_id, geonameid FROM base JOIN geonames ON feature_class = 'P' AND population > 1000000 AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND {distance('lon', 'lat', 'longitude', 'latitude')} < 200000", "base")
def _(t: Tables) -> DataFrame:
    towns = t.geonames.where("feature_class = 'P' and population > 1000000")
    return points_near_points(t.posts, towns, "post_id", "lon", "lat", "geonameid", "longitude", "latitude", DEFAULT.near_m)


@query("op_j13_all_towns", f"SELECT post_id, geonameid FROM base JOIN geonames ON feature_class = 'P' AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND {distance('lon', 'lat', 'longitude', 'latitude')} < {DEFAULT.near_m}", "base")
def _(t: Tables) -> DataFrame:
    """Towns of any population, also of none."""
    return points_near_points(t.posts, t.geonames.where("feature_class = 'P'"), "post_id", "lon", "lat", "geonameid", "longitude", "latitude", DEFAULT.near_m)


@query("op_j14_zones_of_posts", "SELECT post_id, array_to_string(zones, '|') AS zones FROM post_zone", "post_zone")
def _(t: Tables) -> DataFrame:
    return t.zones().select("post_id", F.array_join("zones", "|").alias("zones"))


# --- windows and resolution ---


@query("op_r1_sliding_windows", "SELECT step, count(*) AS candidates, count(DISTINCT post_id) AS posts FROM stepped GROUP BY 1", "stepped")
def _(t: Tables) -> DataFrame:
    return t.stepped().groupBy("step").agg(F.count("*").alias("candidates"), F.count_distinct("post_id").alias("posts"))


@query("op_a2_one_per_user", "SELECT step, toponym, geonameid, user_id, post_id FROM user_row", "user_row")
def _(t: Tables) -> DataFrame:
    return rs.one_per_user(t.stepped()).select("step", "toponym", "geonameid", "user_id", "post_id")


@query("op_a3_type_scores", "SELECT step, toponym, geonameid, users, t_coordinates::BIGINT AS t_coordinates, t_home::BIGINT AS t_home, t_bbox::BIGINT AS t_bbox, t_offset::BIGINT AS t_offset FROM pooled", "pooled")
def _(t: Tables) -> DataFrame:
    return rs.type_scores(t.stepped()).select("step", "toponym", "geonameid", "users", "t_coordinates", "t_home", "t_bbox", "t_offset")


@query("op_a5_average_score", "SELECT step, toponym, geonameid, avg_score FROM averaged", "averaged")
def _(t: Tables) -> DataFrame:
    return rs.average_scores(t.stepped(), settings=AS_WRITTEN).select("step", "toponym", "geonameid", "avg_score")


@query("op_w1_w4_elect", "SELECT step, toponym, geonameid, type, avg_score FROM winner", "winner")
def _(t: Tables) -> DataFrame:
    return rs.elect(rs.average_scores(t.stepped(), settings=AS_WRITTEN)).select("step", "toponym", "geonameid", "type", "avg_score")


@query("resolve_as_written", "SELECT post_id, toponym, step, geonameid, type, avg_score FROM best", "best")
def _(t: Tables) -> DataFrame:
    stepped = t.stepped()
    return rs.best_locations(rs.placed_posts(stepped, rs.elect(rs.average_scores(stepped, settings=AS_WRITTEN)))).select("post_id", "toponym", "step", "geonameid", "type", "avg_score")


@query("resolve_intended")
def _(t: Tables) -> DataFrame:
    stepped = t.stepped()
    averaged = rs.average_scores(stepped, t.posts, t.settings)
    return rs.best_locations(rs.placed_posts(stepped, rs.elect(averaged))).select("post_id", "toponym", "step", "geonameid", "type", "avg_score")


@query(
    "op_w6_j20_upsert",
    "SELECT post_id, toponym, geonameid, avg_score FROM (SELECT *, row_number() OVER (PARTITION BY post_id, toponym ORDER BY avg_score DESC, age, geonameid) AS r FROM (SELECT post_id, l.toponym, l.geonameid, l.avg_score, 0 AS age FROM (SELECT DISTINCT post_id, unnest(locations) AS l FROM posts) UNION ALL SELECT post_id, toponym, geonameid, avg_score, 1 FROM best)) WHERE r = 1",
    "best",
)
def _(t: Tables) -> DataFrame:
    stored = t.raw.select("post_id", F.inline("locations")).select("post_id", "toponym", "geonameid", "avg_score").distinct()
    stepped = t.stepped()
    new = rs.best_locations(rs.placed_posts(stepped, rs.elect(rs.average_scores(stepped, settings=AS_WRITTEN))))
    return rs.merge_locations(stored, new)


# --- searching posts ---

_SPAN = "posted_at BETWEEN TIMESTAMP '2016-01-08 00:00:00' AND TIMESTAMP '2016-01-10 12:00:00'"
_FROM, _TO = "2016-01-08 00:00:00", "2016-01-10 12:00:00"


def _found(t: Tables, **how) -> DataFrame:
    return find_posts(t.raw, F.lit(_FROM).cast("timestamp_ntz"), F.lit(_TO).cast("timestamp_ntz"), **how).select("post_id", "posted_at", "received_at")


@query("op_f1_between", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN}")
def _(t: Tables) -> DataFrame:
    return _found(t)


@query("op_f2_has_location", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN} AND len(locations) > 0")
def _(t: Tables) -> DataFrame:
    return _found(t, locations=True)


@query("op_f3_countries", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN} AND len(list_filter(locations, lambda l: l.geonameid IN (9230, 24328, 22616))) > 0")
def _(t: Tables) -> DataFrame:
    return _found(t, countries=[9230, 24328, 22616])


@query("op_f4_adm1", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN} AND len(list_filter(locations, lambda l: l.geonameid IN (10326, 10062) OR l.adm1_geonameid IN (10326, 10062))) > 0")
def _(t: Tables) -> DataFrame:
    return _found(t, adm1=[10326, 10062])


@query("op_f5_countries_and_adm1", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN} AND len(list_filter(locations, lambda l: l.geonameid IN (9230, 24328, 10326) OR l.adm1_geonameid = 10326)) > 0")
def _(t: Tables) -> DataFrame:
    return _found(t, countries=[9230, 24328], adm1=10326)


@query("op_f6_any_location", "SELECT post_id, received_at FROM posts WHERE len(locations) > 0")
def _(t: Tables) -> DataFrame:
    return t.raw.where(has_location(F.col("locations"))).select("post_id", "received_at")


@query("op_f7_sorted", f"SELECT post_id, posted_at, received_at FROM posts WHERE {_SPAN} ORDER BY posted_at")
def _(t: Tables) -> DataFrame:
    return _found(t, sort=True)


@query("op_s6_count", f"SELECT count(*) AS hits FROM posts WHERE {_SPAN}")
def _(t: Tables) -> DataFrame:
    return _found(t).agg(F.count("*").alias("hits"))


@query("op_d4_steps", "SELECT k AS step, TIMESTAMP '2016-01-04' + k * INTERVAL 6 HOUR AS step_end FROM (SELECT unnest(range(1, 113)) AS k)")
def _(t: Tables) -> DataFrame:
    return daterange(t.spark, START, "2016-02-01 00:00:00", 6, LAST_STEP).select("step", "step_end")


@query("op_a9_exact_copies", "SELECT DISTINCT post_id, posted_at, text FROM (SELECT *, min(posted_at) OVER (PARTITION BY text) AS m FROM base) WHERE posted_at = m", "base")
def _(t: Tables) -> DataFrame:
    return earliest_of_text(t.posts.select(F.lit(1).alias("g"), "post_id", "posted_at", "text"), "g", "posted_at", "text").select("post_id", "posted_at", "text")


@query("op_a10_near_copies")
def _(t: Tables) -> DataFrame:
    rows = t.posts.select(F.concat_ws("|", F.date_trunc("day", "posted_at").cast("string"), "lang").alias("g"), "post_id", "posted_at", "text")
    return without_near_duplicates(rows, "g", "post_id", "posted_at", "text", DEFAULT.near_duplicate_distance)
