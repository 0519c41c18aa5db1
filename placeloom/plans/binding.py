"""The engine's steps over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings, tag_rows
from placeloom.functions.timezones import intervals_table, zones_of_posts
from placeloom.operators import candidates as ca
from placeloom.operators import gazetteer as gz
from placeloom.operators import home as hm
from placeloom.operators import resolve as rs
from placeloom.operators import scoring as sc
from placeloom.session import broadcast_if_small, cut, table

START, FIRST_STEP, LAST_STEP = "2016-01-04 00:00:00", 1, 112
EPOCH = datetime(1970, 1, 1)


class Tables:
    """The inputs of the engine, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT):
        self.spark, self.settings = spark, settings
        self.raw = table(spark, sf_dir, "posts")
        # By post_id, so that leaving out repeats needs no further shuffle and few files still fill all tasks.
        tasks = max(spark.sparkContext.defaultParallelism, self.raw.rdd.getNumPartitions())
        self.posts = ca.base_posts(self.raw.repartition(tasks, "post_id"))
        self.geonames, self.alternates, self.adm1, self.countries, self.words = (table(spark, sf_dir, t) for t in ("geonames", "alternate_names", "adm1", "countries", "most_common_words"))
        self.tags = spark.createDataFrame(tag_rows(), "tag string, lang string")
        self.written: dict[str, DataFrame] = {}
        self._span: tuple[datetime, datetime] | None = None

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What build() gives, as a table written once in the shared folder and read by every later step."""
        if name not in self.written:
            self.written[name] = cut(build())
        return self.written[name]

    def gazetteer(self) -> DataFrame:
        return self.once("gazetteer", lambda: gz.build_gazetteer(self.geonames, self.alternates, self.adm1))

    def admin(self) -> DataFrame:
        return self.once("admin", lambda: gz.admin_names(self.geonames, self.alternates, self.adm1, self.settings))

    def common(self) -> DataFrame:
        return self.once("common", lambda: gz.common_words(self.words, self.geonames, self.settings))

    def grams(self) -> DataFrame:
        return ca.grams_of(self.posts, self.tags, self.settings)

    def names(self) -> DataFrame:
        return ca.found_names(ca.grams_of(self.posts, self.tags, self.settings, self.gazetteer()), self.gazetteer(), gz.country_names(self.admin()), self.common(), self.settings)

    def candidates(self) -> DataFrame:
        return self.once("candidates", lambda: ca.candidates(self.names(), self.gazetteer(), self.settings))

    def zone_names(self) -> list[str]:
        """Names of the time zones in use that the time zone database knows: no more than it has."""
        used = self.geonames.where("time_zone is not null").select("time_zone").distinct()
        known = self.spark.createDataFrame([(z,) for z in sorted(available_timezones())], "time_zone string")
        return [r[0] for r in used.join(broadcast_if_small(known), "time_zone", "left_semi").orderBy("time_zone").collect()]

    def span(self) -> tuple[datetime, datetime]:
        """The times of the first and the last post; a day without posts where there are none."""
        if self._span is None:
            first, last = self.raw.agg(F.min("posted_at"), F.max("posted_at")).first()
            self._span = (first or EPOCH, last or EPOCH)
        return self._span

    def last_step(self) -> int:
        """The number of the last step whose window holds a post."""
        length = timedelta(hours=self.settings.window_h)
        return max(0, (self.span()[1] + length - datetime.fromisoformat(START)) // timedelta(hours=self.settings.slide_h))

    def zones(self) -> DataFrame:
        first, last = self.span()
        return zones_of_posts(self.posts, intervals_table(self.spark, self.zone_names(), first - timedelta(days=1), last + timedelta(days=1)), "post_id", "utc_offset", "posted_at")

    def area_zones(self) -> DataFrame:
        return self.geonames.where("time_zone is not null and country_geonameid is not null").groupBy(F.col("country_geonameid").alias("geonameid")).agg(F.array_sort(F.collect_set("time_zone")).alias("zones"))

    def homes(self) -> DataFrame:
        return self.once("homes", lambda: hm.home_places(self.posts.select("home"), self.admin(), self.gazetteer(), self.settings))

    def scored(self) -> DataFrame:
        return self.once("scored", self._scored)

    def _scored(self) -> DataFrame:
        return sc.score_candidates(self.candidates(), self.posts, self.countries.select("geonameid", "rings"), self.zones(), self.area_zones(), hm.main_home(self.homes()), self.countries.select("geonameid", "continents"), self.settings)

    def stepped(self) -> DataFrame:
        return rs.in_steps(self.scored(), START, FIRST_STEP, LAST_STEP, self.settings)
