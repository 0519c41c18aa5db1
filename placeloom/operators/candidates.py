"""From posts to candidate places: names in the text, the gazetteer's places of that name, and gates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.functions import text as tx
from placeloom.functions.predicates import is_family, side
from placeloom.operators.gazetteer import size_order
from placeloom.session import broadcast_if_small, is_small


def base_posts(posts: DataFrame) -> DataFrame:
    """One row for each post_id, with the author's fields and usable coordinates as plain columns."""
    return posts.select(
        "post_id", "posted_at", "text", "lang", "retweet", F.col("author.id").alias("user_id"), F.col("author.location").alias("home"), F.col("author.utc_offset").alias("utc_offset"),
        F.col("coordinates.lon").alias("lon"), F.col("coordinates.lat").alias("lat"), "bbox",
    ).dropDuplicates(["post_id"])


def tags_by_language(tags: DataFrame) -> DataFrame:
    """(lang, tags): the keywords of each language, lower-case spaces aside, in reverse order of letters."""
    return tags.groupBy("lang").agg(F.sort_array(F.collect_set("tag"), asc=False).alias("tags"))


def one_of(words: list[str]) -> str:
    """A pattern that finds any of the words, branching letter by letter, so that a place where none begins is
    left after one comparison."""
    if "" in words:
        return ""
    first = sorted({w[0] for w in words})
    branches = [re.escape(c) + one_of([w[1:] for w in words if w[0] == c]) for c in first]
    return branches[0] if len(branches) == 1 else f"(?=[{''.join(map(re.escape, first))}])(?:{'|'.join(branches)})"


def any_tag(tags: DataFrame, most: int = 10_000) -> str | None:
    """A pattern that finds any keyword of any language; None where there are more than `most`."""
    if not is_small(tags, most):
        return None
    return one_of([r["tag"] for r in tags.select("tag").where("tag <> ''").distinct().collect()] or ["\U0010ffff"])


def grams_of(posts: DataFrame, tags: DataFrame, settings: Settings = DEFAULT, names: DataFrame | None = None) -> DataFrame:
    """(post_id, lang, gram, cut, first_words, tags): n-grams of posts in languages that have tags, tags cut out.

    With `names`, a table of (name) in lower case, only n-grams that are one of them, or hold a tag, are kept:
    the others never leave the generated code of the scan."""
    # Step by step, so that no step's result is worked out again for each use in the next.
    rows = posts.join(broadcast_if_small(tags_by_language(tags)), "lang").select("post_id", "lang", "tags", tx.clean_text(F.col("text"), lower=False).alias("_clean"))
    rows = rows.select("post_id", "lang", "tags", tx.sentence_first_words(F.col("_clean")).alias("first_words"), F.explode(F.array(tx.tokenize(F.col("_clean"), remove_punctuation=True))).alias("_tokens"))
    # The n-grams are a column before they are rows, so that what follows them is generated code.
    rows = rows.select("post_id", "lang", "tags", "first_words", tx.ngrams(F.col("_tokens"), 1, settings.max_ngram, without=r"\p{N}").alias("_grams"))
    rows = rows.select("post_id", "lang", "tags", "first_words", F.explode("_grams").alias("_gram")).withColumn("_low", F.lower("_gram"))
    pattern = any_tag(tags)
    rows = rows.withColumn("_hit", F.col("_low").rlike(pattern) if pattern else F.lit(True))
    if names is not None:
        known = names.select(F.col("name").alias("_low")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(broadcast_if_small(known), "_low", "left").where(F.col("_hit") | F.col("_known").isNotNull())
    whole = F.array(F.struct(F.col("_gram").alias("gram"), F.lit(False).alias("cut")))
    cut = F.explode(F.when(F.col("_hit"), tx.strip_tags(F.array("_gram"), F.col("tags"))).otherwise(whole))
    return rows.select("post_id", "lang", "tags", "first_words", cut.alias("_g")).select("post_id", "lang", "tags", "first_words", "_g.gram", "_g.cut")


def kept_names(grams: DataFrame, gazetteer: DataFrame, countries: DataFrame, common: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The grams with their toponym that are names of the gazetteer: a country's, or long enough and no common word."""
    rows = grams.withColumn("toponym", F.lower("gram"))
    rows = rows.join(broadcast_if_small(gazetteer.select(F.col("name").alias("toponym")).distinct()), "toponym", "left_semi")
    rows = rows.join(broadcast_if_small(countries.select(F.col("name").alias("toponym"), F.lit(True).alias("_country")).distinct()), "toponym", "left")
    rows = rows.join(broadcast_if_small(common.select("lang", F.col("word").alias("toponym"), F.lit(True).alias("_common"))), ["lang", "toponym"], "left")
    return rows.where(F.col("_country").isNotNull() | ((F.length("toponym") >= settings.min_gram_length) & F.col("_common").isNull()))


def found_names(grams: DataFrame, gazetteer: DataFrame, countries: DataFrame, common: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(post_id, lang, toponym, original, cut, first_word): names of the gazetteer in each post, without those
    that are part of another. A name is kept when it is a country's, or long enough and no common word."""
    rows = kept_names(grams, gazetteer, countries, common, settings)
    seen = F.struct("toponym", (~tx.is_title(F.col("gram"))).alias("plain"), F.col("gram").alias("original"), (F.col("cut") & (F.col("gram") == F.col("toponym"))).alias("cut"))
    posts = rows.groupBy("post_id", "lang").agg(F.collect_set(seen).alias("_seen"), F.first("first_words").alias("first_words"), F.first("tags").alias("tags"))

    def one(t):
        own = F.filter("_seen", lambda s: s["toponym"] == t)
        return F.struct(t.alias("toponym"), F.array_min(F.transform(own, lambda s: F.struct(s["plain"], s["original"])))["original"].alias("original"), F.exists(own, lambda s: s["cut"]).alias("cut"))

    posts = posts.withColumn("_names", F.transform(F.array_distinct(F.transform("_seen", lambda s: s["toponym"])), one))

    def holds(outer, inner):
        return (outer["toponym"] != inner["toponym"]) & F.contains(F.concat(F.lit(" "), outer["toponym"], F.lit(" ")), F.concat(F.lit(" "), inner["toponym"], F.lit(" ")))

    def outer_loses(outer, inner):
        return tx.starts_upper(inner["original"]) & ~tx.all_parts_upper(outer["original"])

    def loses(t):
        return F.exists("_names", lambda o: holds(o, t) & ~outer_loses(o, t)) | F.exists("_names", lambda i: holds(t, i) & outer_loses(t, i))

    left = posts.select("post_id", "lang", "first_words", "tags", F.explode(F.filter("_names", lambda t: ~loses(t))).alias("n"))
    left = left.where(~F.array_contains("tags", F.col("n.toponym")))
    return left.select("post_id", "lang", "n.toponym", "n.original", "n.cut", F.array_contains("first_words", F.col("n.toponym")).alias("first_word"))


def dominated(gazetteer: DataFrame) -> DataFrame:
    """(toponym, geonameid, rival_population): places that a larger or better known place of the same name
    and family stands for, with the population of the most populous such rival."""
    fields = ["geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude", "translations"]
    a, b = (gazetteer.select("name", *(F.col(f).alias(p + f) for f in fields)) for p in ("a_", "b_"))
    pairs = a.join(b, "name").where(F.col("a_geonameid") < F.col("b_geonameid")).where(is_family(side("a_"), side("b_"), F.col("name"), F.col("name"), siblings=False, by_length=False))
    a_wins = (F.col("a_translations") > F.col("b_translations")) | ((F.col("a_translations") == F.col("b_translations")) & (size_order(F.col("a_type")) <= size_order(F.col("b_type"))))
    lost = pairs.select(F.col("name").alias("toponym"), F.when(a_wins, F.col("b_geonameid")).otherwise(F.col("a_geonameid")).alias("geonameid"), F.when(a_wins, F.col("a_population")).otherwise(F.col("b_population")).alias("rival_population"))
    return lost.groupBy("toponym", "geonameid").agg(F.max("rival_population").alias("rival_population"))


def candidates(names: DataFrame, gazetteer: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Every place each found name may mean: large enough for how it is written, and not dominated."""
    places = broadcast_if_small(gazetteer.withColumnRenamed("name", "toponym"))
    lost = broadcast_if_small(dominated(gazetteer))
    written = F.col("lang").isin(*settings.capitalizing) & ~F.col("first_word") & tx.is_title(F.col("original"))
    rows = names.withColumn("least", F.when(written, settings.min_population_capitalized).otherwise(settings.min_population_other))
    rows = rows.join(places, "toponym").where(F.col("population") >= F.col("least")).join(lost, ["toponym", "geonameid"], "left")
    return rows.where(F.col("rival_population").isNull() | (F.col("rival_population") < F.col("least"))).drop("rival_population", "least")
