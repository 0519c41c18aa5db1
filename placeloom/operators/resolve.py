"""Pooling scores over sliding windows and electing one place for each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.functions.text import starts_upper
from placeloom.operators.similar_posts import without_near_duplicates

SCORES = ("coordinates", "home", "bbox", "family", "offset")
FACTS = ("type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude", "languages", "abbreviations")


def steps_of(time: Column, start: str, settings: Settings = DEFAULT) -> Column:
    """Numbers of the steps whose window holds a time. Step k ends at start + k slides; both ends count."""
    slide, length = settings.slide_h * 3_600_000_000, settings.window_h * 3_600_000_000
    since = F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    return F.sequence(F.ceil(since / slide), F.floor((since + length) / slide))


def in_steps(scored: DataFrame, start: str, first: int, last: int, settings: Settings = DEFAULT) -> DataFrame:
    """Scored candidates repeated for every step from first to last whose window holds their post."""
    return scored.withColumn("step", F.explode(F.filter(steps_of(F.col("posted_at"), start, settings), lambda k: (k >= first) & (k <= last))))


def language_gate(languages: Column, lang: Column) -> Column:
    return F.array_contains(languages, "general") | F.coalesce(F.array_contains(languages, lang), F.lit(False))


def one_per_user(stepped: DataFrame) -> DataFrame:
    """The latest post of each author for each step, name and place; of equal times the least post_id.
    A minimum of structs, so that a busy author's posts are reduced before the shuffle."""
    key = ["step", "toponym", "geonameid", "user_id"]
    rest = [c for c in stepped.columns if c not in key + ["posted_at", "post_id"]]
    # The facts are those of the place; only what differs by post goes through the minimum.
    latest = F.min(F.struct((-F.unix_micros(F.col("posted_at").cast("timestamp"))).alias("_o"), "post_id", "lang", *(c for c in rest if c.startswith("s_")))).alias("_l")
    facts = [F.first(c).alias(c) for c in FACTS if c in rest]
    return stepped.groupBy(*key).agg(latest, *facts).select(*key, "_l.post_id", "_l.lang", *(f"_l.{c}" for c in rest if c.startswith("s_")), *(c for c in FACTS if c in rest))


def type_scores(stepped: DataFrame) -> DataFrame:
    """For each step, name and place: users, and for each score its whole part t_ over posts that pass the
    language gate (one a user) and its average a_ over all of them."""
    users = one_per_user(stepped)
    gate = language_gate(F.col("languages"), F.col("lang"))
    totals = [F.floor(F.sum(F.when(gate, F.col(f"s_{s}")).otherwise(0.0))).alias(f"t_{s}") for s in SCORES]
    got = users.groupBy("step", "toponym", "geonameid").agg(F.count("*").alias("users"), *totals, *(F.first(c).alias(c) for c in FACTS))
    return got.withColumns({f"a_{s}": F.col(f"t_{s}") / F.col("users") for s in SCORES})


def family_scores(stepped: DataFrame, texts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(step, toponym, geonameid, t_family, a_family) over posts without near duplicates, for groups that
    have any family score."""
    key = ["step", "toponym", "geonameid"]
    totals = stepped.groupBy(*key).agg(F.sum(F.when(F.col("s_family") > 0, 1).otherwise(0)).alias("_kin")).where("_kin > 0")
    group = stepped.join(totals, key).withColumn("_group", F.xxhash64(*key))
    alone = group.where((F.col("_kin") == 1) & (F.col("s_family") > 0))
    many = group.where("_kin > 1").join(texts.select("post_id", "text"), "post_id")
    kept = without_near_duplicates(many.select("_group", "post_id", "posted_at", "text"), "_group", "post_id", "posted_at", "text", settings.near_duplicate_distance)
    used = alone.unionByName(many.drop("text").join(kept, ["_group", "post_id"], "left_semi"))
    gate = language_gate(F.col("languages"), F.col("lang"))
    got = used.groupBy(*key).agg(F.floor(F.sum(F.when(gate, F.col("s_family")).otherwise(0.0))).alias("t_family"), F.count("*").alias("_n"))
    return got.select(*key, "t_family", (F.col("t_family") / F.col("_n")).alias("a_family"))


def average_scores(stepped: DataFrame, texts: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """type_scores with the family score by the settings' mode, and avg_score, the rounded sum of averages."""
    got = type_scores(stepped)
    key = ["step", "toponym", "geonameid"]
    if settings.family_mode == "as_written":
        any_kin = stepped.groupBy(*key).agg((F.sum("s_family") > 0).alias("_kin"))
        got = got.join(any_kin, key)
        for p in ("t_", "a_"):
            got = got.withColumn(f"{p}family", F.when(F.col("_kin"), F.col(f"{p}bbox")).otherwise(F.lit(0)))
        got = got.drop("_kin")
    else:
        got = got.drop("t_family", "a_family").join(family_scores(stepped, texts, settings), key, "left").na.fill(0, ["t_family", "a_family"])
    total = F.col("a_coordinates") + F.col("a_home") + F.col("a_bbox") + F.col("a_family") + F.col("a_offset")
    return got.withColumn("avg_score", F.round(total, 3))


def elect(averaged: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The winner of each step and name.

    Places under the threshold are out, countries and continents excepted. If there is one of
    those, the most populous wins. Else the best score does (then population, then the least
    id), unless a region of the winner's country is a candidate too: then the best such region.
    """
    able = averaged.where((F.col("avg_score") >= settings.threshold) | F.col("type").isin("country", "continent"))
    by = Window.partitionBy("step", "toponym")
    rank = by.orderBy(F.desc("avg_score"), F.desc("population"), "geonameid")
    able = able.withColumn("_wide", F.col("type").isin("country", "continent"))
    able = able.withColumn("_any", F.max("_wide").over(by)).withColumn("_rank", F.row_number().over(rank))
    top_type, top_country = (F.first(c).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("type", "country_geonameid"))
    able = able.withColumn("_top_type", top_type).withColumn("_top_country", top_country)
    kin = (F.col("type") == "adm1") & (F.col("_top_type") != "adm1") & F.col("country_geonameid").eqNullSafe(F.col("_top_country"))
    order = F.when(F.col("_any"), F.when(F.col("_wide"), -F.col("population")).otherwise(F.lit(None).cast("long"))).otherwise(F.when(kin, F.col("_rank") - 1_000_000).otherwise(F.col("_rank")))
    first = F.row_number().over(by.orderBy(order.asc_nulls_last(), "geonameid"))
    return able.withColumn("_first", first).where("_first = 1").drop("_wide", "_any", "_rank", "_top_type", "_top_country", "_first")


def placed_posts(stepped: DataFrame, winners: DataFrame) -> DataFrame:
    """(step, post_id, toponym, geonameid, ...): winners given to the posts that name them, if the post's
    language fits or the name is written as one of its codes; in a post that writes some names with a
    capital, the others are out unless what is left of a tag."""
    won = winners.select("step", "toponym", "geonameid", "avg_score")
    rows = stepped.join(won, ["step", "toponym", "geonameid"])
    fits = language_gate(F.col("languages"), F.col("lang")) | (F.array_contains("languages", "abbr") & F.array_contains("abbreviations", F.col("original")))
    rows = rows.where(fits).withColumn("_upper", starts_upper(F.col("original")))
    rows = rows.withColumn("_any", F.max("_upper").over(Window.partitionBy("step", "post_id")))
    return rows.where(F.col("_upper") | ~F.col("_any") | F.col("cut")).select("step", "post_id", "toponym", "geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "avg_score")


def best_locations(placed: DataFrame) -> DataFrame:
    """Over all steps, each post's best place for each name: the highest score, of equal ones the earliest step."""
    best = F.min(F.struct((-F.col("avg_score")).alias("_o"), "step", "geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "avg_score")).alias("b")
    return placed.groupBy("post_id", "toponym").agg(best).select("post_id", "toponym", "b.step", "b.geonameid", "b.type", "b.population", "b.country_geonameid", "b.adm1_geonameid", "b.avg_score")


def merge_locations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(post_id, toponym, geonameid, avg_score) of stored and new locations: the new one only where it is
    strictly better or there was none."""
    keep = ["post_id", "toponym", "geonameid", "avg_score"]
    both = stored.select(*keep, F.lit(0).alias("_age")).unionByName(new.select(*keep, F.lit(1).alias("_age")))
    best = both.groupBy("post_id", "toponym").agg(F.min(F.struct((-F.col("avg_score")).alias("_o"), "_age", "geonameid", "avg_score")).alias("b"))
    return best.select("post_id", "toponym", "b.geonameid", "b.avg_score")
