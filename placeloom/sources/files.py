"""Readers of the text files a gazetteer is built from, and of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.session import broadcast_if_small

# What is null in a dump. 'NA' isn't: it is a country and a continent.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NULL", "NaN", "nan")

POST_SCHEMA = (
    "post_id string, posted_at timestamp_ntz, received_at timestamp_ntz, text string, lang string, retweet boolean, "
    "author struct<id:bigint,location:string,time_zone:string,utc_offset:int>, coordinates struct<lon:double,lat:double>, bbox array<double>, urls array<string>, "
    "locations array<struct<toponym:string,geonameid:int,population:bigint,country_geonameid:int,adm1_geonameid:int,avg_score:double>>"
)


# Columns of the public gazetteer dumps, in their order.
PLACE_COLUMNS = (
    "geonameid full_name asciiname alternatenames latitude longitude feature_class feature_code country cc2 "
    "admin1_code admin2_code admin3_code admin4_code population elevation dem time_zone modification_date"
).split()
ALTERNATE_COLUMNS = "alternatenameid geonameid isolanguage full_name is_preferred is_short is_colloquial is_historic since until".split()
COUNTRY_COLUMNS = (
    "iso2 iso3 iso_numeric fips name capital area population continent tld currency_code currency_name phone "
    "postal_format postal_regex languages geonameid neighbours equivalent_fips"
).split()


def nulled(value: Column) -> Column:
    return F.when(value.isin(*NULLS), None).otherwise(value)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of a text file with their numbers from 0. Lines are numbered within each of
    the reader's splits and the splits' sizes added up, so that no task holds the whole file."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("f", "b").orderBy("m")))
    sizes = rows.groupBy("f", "b").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(broadcast_if_small(sizes.select("f", "b", "before")), ["f", "b"]).select("value", (F.col("before") + F.col("n") - 1).alias("line"))


def read_tsv(spark: SparkSession, path: str, columns: list[str], types: dict[str, str] | None = None, keep: list[str] | None = None, skip_lines: int = 0, comment: str | None = None) -> DataFrame:
    """Tab-separated columns by name, unquoted, read as text, nulls by NULLS, then cast. A value that doesn't
    fit its type is null. skip_lines leaves out that many first lines of each file; comment lines never count
    as rows."""
    if skip_lines:
        parts = F.split(F.col("value"), "\t")
        raw = _numbered(spark, path).where(F.col("line") >= skip_lines)
        raw = raw.where(~F.col("value").startswith(comment)) if comment else raw
        rows = raw.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))
    else:
        reader = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE")
        rows = (reader.option("comment", comment) if comment else reader).csv(path)
    types = types or {}

    def cast(c: str) -> Column:
        kind = types.get(c, "string")
        value = nulled(F.col(c))
        if kind in ("int", "long", "bigint", "short"):
            number = value.try_cast("double")
            return F.when(~F.isnan(number), number).try_cast(kind)
        return value if kind == "string" else value.try_cast(kind)

    return rows.select(*(cast(c).alias(c) for c in (keep or columns)))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places of a gazetteer dump: (geonameid, name in lower case, full_name, feature_class, feature_code, country,
    admin1_code, population, longitude, latitude, time_zone). Decompressed by Spark where the file is gzipped or
    bzipped; an unknown value is null."""
    kinds = {"geonameid": "int", "population": "long", "longitude": "double", "latitude": "double"}
    keep = ["geonameid", "full_name", "feature_class", "feature_code", "country", "admin1_code", "population", "longitude", "latitude", "time_zone"]
    return read_tsv(spark, path, PLACE_COLUMNS, kinds, keep).withColumn("name", F.lower("full_name"))


def read_alternates(spark: SparkSession, path: str) -> DataFrame:
    """(alternatenameid, geonameid, isolanguage, full_name, alternate_name in lower case) of an alternate names dump."""
    rows = read_tsv(spark, path, ALTERNATE_COLUMNS, {"alternatenameid": "int", "geonameid": "int"}, ALTERNATE_COLUMNS[:4])
    return rows.withColumn("alternate_name", F.lower("full_name"))


def read_country_info(spark: SparkSession, path: str) -> DataFrame:
    """(geonameid, iso2, iso3, continent, languages, name in lower case) of a country dump; comment lines are left out."""
    rows = read_tsv(spark, path, COUNTRY_COLUMNS, {"geonameid": "int"}, ["geonameid", "iso2", "iso3", "continent", "languages", "name"], comment="#")
    return rows.withColumn("name", F.lower("name"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """(lang, capitalizing) of a comma-separated table with a head: language code, whether it writes names with capitals."""
    rows = spark.read.option("header", True).schema("lang string, capitalizing string").csv(path)
    return rows.where("lang is not null").select(F.trim("lang").alias("lang"), F.lower(F.trim("capitalizing")).isin("1", "1.0", "true", "yes", "y").alias("capitalizing"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag, lang) of lines 'tag, lang'; spaces in tags are left out."""
    lines = spark.read.text(path).where(F.col("value").contains(","))
    return lines.select(F.replace(F.regexp_extract("value", "^(.*),[^,]*$", 1), F.lit(" "), F.lit("")).alias("tag"), F.trim(F.regexp_extract("value", ",([^,]*)$", 1)).alias("lang"))


def read_zone_names(spark: SparkSession, path: str) -> DataFrame:
    """(shown_name, zone) of a comma-separated file."""
    return spark.read.schema("shown_name string, zone string").csv(path).where("zone is not null")


def read_country_zones(spark: SparkSession, path: str) -> DataFrame:
    """(iso2, name) of a commented tab-separated file of code, coordinates, zone."""
    return read_tsv(spark, path, ["iso2", "coordinates", "name"], keep=["iso2", "name"], comment="#")


def read_word_ranks(spark: SparkSession, path: str, lang: str, most: int = 10_000) -> DataFrame:
    """(n, lang, word): the first word of each of the first `most` lines, n from 1."""
    return _numbered(spark, path).where(F.col("line") < most).select((F.col("line") + 1).cast("int").alias("n"), F.lit(lang).alias("lang"), F.split("value", " ")[0].alias("word"))


def unpivot_zones(sheet: DataFrame) -> DataFrame:
    """(geonameid, zone) of a sheet with a column of zone names for each continent id."""
    return sheet.unpivot([], sheet.columns, "geonameid", "zone").where("zone is not null").withColumn("geonameid", F.col("geonameid").cast("int"))


def read_posts(spark: SparkSession, path: str, kind: str = "parquet", adapt: Callable[[DataFrame], DataFrame] | None = None, schema: str = POST_SCHEMA) -> DataFrame:
    """Posts of a Parquet or JSON folder with the fixed schema; nothing is inferred. Posts of another form are read
    with their own schema and brought to the engine's columns by `adapt`."""
    rows = spark.read.schema(schema).format(kind).load(path)
    return adapt(rows) if adapt else rows


def stream_posts(spark: SparkSession, path: str, kind: str = "parquet", files_per_batch: int | None = None, adapt: Callable[[DataFrame], DataFrame] | None = None, schema: str = POST_SCHEMA) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
    return adapt(rows) if adapt else rows


def column_names(spark: SparkSession, name: str) -> list[str]:
    """Columns of a table of the catalogue; none where there is no such table."""
    return spark.table(name).columns if spark.catalog.tableExists(name) else []
