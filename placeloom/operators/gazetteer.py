"""Building the gazetteer from places, alternate names, areas and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.config import ADM_CODES, DEFAULT, KEPT_CODES, TOWN_CODES, Settings
from placeloom.operators.spatial import points_in_regions
from placeloom.session import broadcast_if_small

# Continents by code, as geonameids.
CONTINENT_IDS = {"AF": 6255146, "AS": 6255147, "EU": 6255148, "NA": 6255149, "OC": 6255151, "SA": 6255150, "AN": 6255152}

# Countries on two continents, by geonameid, with the continents' geonameids.
TWO_CONTINENTS = {
    2017370: (6255148, 6255147),
    1643084: (6255147, 6255151),
    1522867: (6255147, 6255148),
    587116: (6255147, 6255148),
    614540: (6255147, 6255148),
    298795: (6255147, 6255148),
    357994: (6255147, 6255146),
    3703430: (6255149, 6255150),
}


def keep_features(places: DataFrame, adm1: DataFrame) -> DataFrame:
    """Places with a feature code in use or whose id is a region's."""
    ids = adm1.select(F.col("geonameid").alias("_adm1")).distinct()
    joined = places.join(ids, places["geonameid"] == ids["_adm1"], "left")
    return joined.where(F.col("feature_code").isin(*KEPT_CODES) | F.col("_adm1").isNotNull()).drop("_adm1")


def keep_alternates(alternates: DataFrame, places: DataFrame) -> DataFrame:
    """Names of known places that aren't links or post codes; a null language is kept."""
    named = alternates.where(F.col("isolanguage").isNull() | ~F.col("isolanguage").isin("link", "post"))
    return named.join(places.select("geonameid").distinct(), "geonameid", "left_semi")


def unique_names(places: DataFrame, alternates: DataFrame) -> DataFrame:
    return places.select("name").unionAll(alternates.select(F.col("alternate_name").alias("name"))).distinct()


def new_names(names: DataFrame, indexed: DataFrame) -> DataFrame:
    """Names that aren't in the gazetteer yet."""
    return names.join(indexed.select("name").distinct(), "name", "left_anti")


def translations(alternates: DataFrame) -> DataFrame:
    """(geonameid, translations): how many names each place has."""
    return alternates.groupBy("geonameid").agg(F.count("*").alias("translations"))


def location_type(code: Column, is_adm1: Column) -> Column:
    """town, adm1, country, continent or null; the first that fits."""
    return F.when(code.isin(*TOWN_CODES), "town").when(code.isin(*ADM_CODES) | is_adm1, "adm1").when(code == "PCLI", "country").when(code == "CONT", "continent")


def size_order(kind: Column) -> Column:
    """0 for the largest kind."""
    return F.when(kind == "continent", 0).when(kind == "country", 1).when(kind == "adm1", 2).otherwise(3)


def build_gazetteer(places: DataFrame, alternates: DataFrame, adm1: DataFrame) -> DataFrame:
    """One row for each name and place: languages ('general' for a main name), abbreviations, type and
    the place's data. Population null counts as 0; places of no type are left out."""
    kept = keep_features(places, adm1)
    alternates = keep_alternates(alternates, kept)
    main = kept.select("name", "geonameid", F.lit("general").alias("language"), F.lit(None).cast("string").alias("abbreviation"))
    other = alternates.select(F.col("alternate_name").alias("name"), "geonameid", F.col("isolanguage").alias("language"), F.when(F.col("isolanguage") == "abbr", F.col("full_name")).alias("abbreviation"))
    named = main.unionByName(other).groupBy("name", "geonameid").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("abbreviation")).alias("abbreviations"))
    regions = adm1.select(F.col("geonameid").alias("_adm1")).distinct()
    facts = kept.join(translations(alternates), "geonameid", "left").join(regions, F.col("geonameid") == F.col("_adm1"), "left")
    facts = facts.select(
        "geonameid", "feature_code", location_type(F.col("feature_code"), F.col("_adm1").isNotNull()).alias("type"), F.coalesce("population", F.lit(0)).alias("population"),
        "longitude", "latitude", "country_geonameid", "adm1_geonameid", "time_zone", F.coalesce("translations", F.lit(0)).alias("translations"),
    )
    return named.join(facts.where("type is not null"), "geonameid")


def gazetteer_documents(gazetteer: DataFrame) -> DataFrame:
    """(name, locations): the nested form, one row for each name."""
    fields = [c for c in gazetteer.columns if c != "name"]
    return gazetteer.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("geonameid", *(c for c in fields if c != "geonameid")))).alias("locations"))


def fill_regions(places: DataFrame, adm1: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """places with region: the child table's parent if there is one, else the region around the place
    (the least id of several). Only populated places are looked up in space."""
    points = places.where(F.col("feature_code").isin(*TOWN_CODES, "PPLX"))
    around = points_in_regions(points, adm1, "geonameid", "longitude", "latitude", "region", "rings") if "region" in adm1.columns else points_in_regions(points, adm1.withColumnRenamed("geonameid", "region"), "geonameid", "longitude", "latitude", "region", "rings")
    around = around.groupBy("geonameid").agg(F.min("region").alias("region"))
    filled = places.join(around, "geonameid", "left")
    if children is None:
        return filled
    parents = children.groupBy(F.col("adm2").alias("geonameid")).agg(F.min("adm1_parent").alias("_parent"))
    return filled.join(parents, "geonameid", "left").withColumn("region", F.coalesce("_parent", "region")).drop("_parent")


def fill_time_zones(places: DataFrame, zones: DataFrame) -> DataFrame:
    """places with zone: the time zone area (name, rings) around the place, the first name of several."""
    around = points_in_regions(places, zones, "geonameid", "longitude", "latitude", "name", "rings").groupBy("geonameid").agg(F.min("name").alias("zone"))
    return places.join(around, "geonameid", "left")


def add_countries(places: DataFrame, countries: DataFrame, iso2: str = "country") -> DataFrame:
    """places with country_geonameid from the two-letter code; an unknown code gives null."""
    return places.join(broadcast_if_small(countries.select(F.col("iso2").alias(iso2), F.col("geonameid").alias("country_geonameid"))), iso2, "left")


def zones_per_country(zones: DataFrame, countries: DataFrame) -> DataFrame:
    """(geonameid, zones): the time zones of each country, from (iso2, name) rows."""
    return zones.join(broadcast_if_small(countries.select("iso2", "geonameid")), "iso2").groupBy("geonameid").agg(F.array_sort(F.collect_set("name")).alias("zones"))


def continents_of(code: Column, overrides: dict[str, list[str]] | None = None, iso2: Column | None = None) -> Column:
    """Continent ids of a continent code; countries in `overrides` belong to several continents."""
    table = F.create_map(*(F.lit(x) for k, v in CONTINENT_IDS.items() for x in (k, v)))
    own = F.array(table[code])
    for country, codes in (overrides or {}).items():
        own = F.when(iso2 == country, F.array(*(F.lit(CONTINENT_IDS[c]) for c in codes))).otherwise(own)
    return own


def country_table(info: DataFrame, outlines: DataFrame) -> DataFrame:
    """(geonameid, iso2, iso3, continents, languages, name, rings) from read_country_info and outlines (iso2, rings).
    Countries on two continents have both; outlines of a code in several rows are parts of it, a country without
    any has null rings."""
    two = F.create_map(*(x for k, ids in TWO_CONTINENTS.items() for x in (F.lit(k), F.array(*map(F.lit, ids)))))
    continents = F.coalesce(F.try_element_at(two, F.col("geonameid")), continents_of(F.col("continent")))
    shapes = outlines.where("iso2 is not null").groupBy("iso2").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    return info.join(broadcast_if_small(shapes), "iso2", "left").select("geonameid", "iso2", "iso3", continents.alias("continents"), "languages", "name", "rings")


def region_parts(parts: DataFrame, key: str = "geonameid") -> DataFrame:
    """(key, rings), one row for each part of a region, under its absolute id; an id of 0 is left out. A point is in
    a region when any part holds it, so that parts may overlap: points_in_regions over these rows, made distinct,
    is the union of the parts."""
    return parts.select(F.abs(F.col(key)).alias(key), "rings").where(F.col(key) >= 1)


def merge_regions(parts: DataFrame, key: str = "geonameid") -> DataFrame:
    """One row for each absolute id with the rings of all its parts; ids below 1 before that are parts too,
    an id of 0 is left out. For parts that don't overlap, even-odd gives their union."""
    merged = parts.withColumn(key, F.abs(F.col(key))).where(F.col(key) >= 1)
    return merged.groupBy(key).agg(F.flatten(F.collect_list("rings")).alias("rings"))


def admin_names(places: DataFrame, alternates: DataFrame, adm1: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(name, geonameid, type, population, abbreviations, ...): names of countries and regions, main and alternate.
    The abbreviations are those of the place, whatever the name."""
    kinds = places.join(adm1.select(F.col("geonameid").alias("_adm1")).distinct(), F.col("geonameid") == F.col("_adm1"), "left")
    kinds = kinds.withColumn("type", location_type(F.col("feature_code"), F.col("_adm1").isNotNull())).where("type in ('adm1', 'country')")
    kinds = kinds.select("geonameid", "name", "type", F.coalesce("population", F.lit(0)).alias("population"), "country_geonameid", "adm1_geonameid", "longitude", "latitude")
    alternates = keep_alternates(alternates, kinds)
    short = alternates.where("isolanguage = 'abbr'").groupBy("geonameid").agg(F.array_sort(F.collect_set("full_name")).alias("abbreviations"))
    names = kinds.select("name", "geonameid").unionByName(alternates.select(F.col("alternate_name").alias("name"), "geonameid")).distinct()
    facts = kinds.drop("name").join(short, "geonameid", "left").withColumn("abbreviations", F.coalesce("abbreviations", F.array().cast("array<string>")))
    return names.join(facts, "geonameid")


def country_names(names: DataFrame) -> DataFrame:
    return names.where("type = 'country'").select("name").distinct()


def common_words(words: DataFrame, places: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(lang, word): the most common words of each language that aren't names of large places."""
    from pyspark.sql import Window

    ranked = words.where(F.col("n") <= settings.common_words_cap).withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("n", "word")))
    large = places.where(F.col("population") > settings.common_exclude_population).select(F.col("name").alias("word")).distinct()
    return ranked.where(F.col("_rank") <= settings.common_words).select("lang", "word").join(large, "word", "left_anti")
