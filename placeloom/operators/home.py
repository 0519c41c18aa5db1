"""The places that authors' home fields may name: the exact grammar over admin names and the gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.functions.predicates import is_family, side
from placeloom.functions.text import strip
from placeloom.session import broadcast_if_small

PLACE = ["geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude"]


def split_home(home: Column) -> Column:
    """The alternatives of a home field: split at slashes, then at ' and ', then at ampersands."""

    def at(parts: Column, mark: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.split(p, mark)))

    return at(at(F.split(home, "/"), " and "), "&")


def home_forms(homes: DataFrame) -> DataFrame:
    """(home, part, n, text, lower): each alternative stripped, dots left out, with its number of comma
    parts. Of three parts the first and second are joined to one; more are dropped."""
    rows = homes.select("home", F.posexplode(split_home(F.col("home"))).alias("part", "_t")).withColumn("text", F.replace(strip(F.col("_t")), F.lit("."), F.lit("")))
    rows = rows.withColumn("_c", F.split("text", ",")).withColumn("n", F.size("_c"))
    joined = strip(F.concat(F.get("_c", F.lit(0)), F.get("_c", F.lit(1))))
    rows = rows.withColumn("text", F.when(F.col("n") == 3, joined).otherwise(F.col("text"))).withColumn("n", F.when(F.col("n") == 3, 1).otherwise(F.col("n")))
    return rows.where("n <= 2").select("home", "part", "n", "text", F.lower("text").alias("lower"))


def home_parents(forms: DataFrame, admin: DataFrame) -> DataFrame:
    """(home, part, name, child, said, parent fields): the admin area each alternative ends in or gives after
    its comma. Of one part the shortest usable run of last words counts. An area that has abbreviations
    is found by those only."""
    one = forms.where("n = 1").withColumn("_w", F.split("lower", " ")).withColumn("_o", F.split("text", " "))
    one = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w"))))
    tail = F.array_join(F.slice("_w", -F.col("k"), F.col("k")), " ")
    one = one.select("home", "part", "k", tail.alias("name"), F.array_join(F.slice("_o", -F.least("k", F.size("_o")), F.least("k", F.size("_o"))), " ").alias("original"), strip(F.substring(F.col("lower"), F.lit(1), F.length("lower") - F.length(tail))).alias("child"))
    two = forms.where("n = 2").withColumn("_c", F.split("lower", ",")).withColumn("_o", F.split("text", ","))
    two = two.select("home", "part", F.lit(1).alias("k"), strip(F.get("_c", F.lit(1))).alias("name"), strip(F.get("_o", F.lit(1))).alias("original"), strip(F.get("_c", F.lit(0))).alias("child"))
    met = one.unionByName(two).join(broadcast_if_small(admin), "name").where((F.size("abbreviations") == 0) | F.array_contains("abbreviations", F.col("original")))
    least = met.groupBy("home", "part").agg(F.min("k").alias("k"))
    return met.join(least, ["home", "part", "k"]).select("home", "part", "name", "original", "child", *PLACE)


def home_places(homes: DataFrame, admin: DataFrame, gazetteer: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(home, toponym, place fields): what each distinct home field may name; none gives no row.

    An area with nothing before it is the home itself. What stands before it is looked up in the
    gazetteer: its most populous place that isn't a mere code is the home, the area where there is
    none. Without an area, a town of at least home_min_population whose name is the whole field (or
    what follows the comma) is the home. A place that has a code among its languages needs that
    exact code as written and, below an area, must belong to it.
    """
    forms = home_forms(homes.where("home is not null").select("home").distinct())
    parents = home_parents(forms, admin)
    names = broadcast_if_small(gazetteer.select(F.col("name").alias("child"), *(F.col(f).alias("g_" + f) for f in PLACE), "languages", "abbreviations"))
    coded = F.array_contains("languages", "abbr")

    kids = parents.where("child <> ''").withColumnsRenamed({f: "p_" + f for f in PLACE}).join(names, "child")
    related = is_family(side("g_"), side("p_"), F.col("child"), F.col("name"), siblings=False, settings=settings)
    usable = ~coded | (F.array_contains("abbreviations", F.col("original")) & related)
    key = ["home", "part", "name", "child", "p_geonameid"]
    best = kids.groupBy(*key).agg(F.max("g_population").alias("_top"), F.min(F.when(usable, F.struct((-F.col("g_population")).alias("_order"), *("g_" + f for f in ["geonameid"] + PLACE[1:])))).alias("_best")).where("_top > 0 and _best is not null")
    taken = best.select("home", "part", F.col("child").alias("toponym"), *(F.col("_best.g_" + f).alias(f) for f in PLACE), F.col("p_geonameid").alias("_parent"))
    left = parents.join(taken.select("home", "part", F.col("_parent").alias("geonameid"), F.lit(True).alias("_t")).distinct(), ["home", "part", "geonameid"], "left").where("_t is null")
    areas = left.select("home", "part", F.col("name").alias("toponym"), *PLACE)

    lone = forms.join(parents.select("home", "part").distinct(), ["home", "part"], "left_anti")
    lone = lone.select("home", "part", F.when(F.col("n") == 1, F.col("lower")).otherwise(strip(F.get(F.split("lower", ","), F.lit(1)))).alias("child"), F.when(F.col("n") == 1, F.col("text")).otherwise(strip(F.get(F.split("text", ","), F.lit(1)))).alias("original"))
    towns = lone.join(names, "child").groupBy("home", "part", "child").agg(F.max("g_population").alias("_top"), F.min(F.when(~coded | F.array_contains("abbreviations", F.col("original")), F.struct((-F.col("g_population")).alias("_order"), *("g_" + f for f in ["geonameid"] + PLACE[1:])))).alias("_best"))
    towns = towns.where((F.col("_top") >= settings.home_min_population) & F.col("_best").isNotNull()).select("home", F.col("child").alias("toponym"), *(F.col("_best.g_" + f).alias(f) for f in PLACE))
    return taken.select("home", "toponym", *PLACE).unionByName(areas.select("home", "toponym", *PLACE)).unionByName(towns).distinct()


def main_home(places: DataFrame) -> DataFrame:
    """(home, home_toponym, home_ fields): the most populous place of each home field."""
    best = places.groupBy("home").agg(F.min(F.struct((-F.col("population")).alias("_order"), "geonameid", "toponym", *PLACE[1:])).alias("b"))
    return best.select("home", F.col("b.toponym").alias("home_toponym"), *(F.col("b." + f).alias("home_" + f) for f in PLACE))
