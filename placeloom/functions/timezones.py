"""Time zones by UTC offset: a table of validity intervals in place of a search at run time."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small


def offset_intervals(zones: Iterable[str], start: datetime, end: datetime) -> list[tuple[str, int, datetime, datetime]]:
    """(zone, offset in seconds, valid from, valid to) over [start, end); to the second, in UTC."""
    out = []
    for name in zones:
        zone = ZoneInfo(name)

        def at(t: datetime, zone: ZoneInfo = zone) -> int:
            return int(t.replace(tzinfo=timezone.utc).astimezone(zone).utcoffset().total_seconds())

        since, offset, t = start, at(start), start
        while t < end:
            ahead = min(t + timedelta(days=3), end)
            if at(ahead) != offset:
                lo, hi = t, ahead
                while hi - lo > timedelta(seconds=1):
                    mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                    lo, hi = (mid, hi) if at(mid) == offset else (lo, mid)
                out.append((name, offset, since, hi))
                since, offset, ahead = hi, at(hi), hi
            t = ahead
        out.append((name, offset, since, end))
    return out


def intervals_table(spark: SparkSession, zones: Iterable[str], start: datetime, end: datetime) -> DataFrame:
    return spark.createDataFrame(offset_intervals(zones, start, end), "zone string, offset_s int, valid_from timestamp_ntz, valid_to timestamp_ntz")


def zones_of_posts(posts: DataFrame, intervals: DataFrame, key: str, offset: str, time: str) -> DataFrame:
    """(key, zones): the zones whose offset at the post's time is the author's. An equi-join on the
    offset; posts without an offset or time give no row."""
    seen = posts.where(F.col(offset).isNotNull() & F.col(time).isNotNull()).select(F.col(offset).alias("offset_s"), F.col(key).alias(key), F.col(time).alias("_time"))
    met = seen.join(broadcast_if_small(intervals), "offset_s").where((F.col("_time") >= F.col("valid_from")) & (F.col("_time") < F.col("valid_to")))
    return met.groupBy(key).agg(F.array_sort(F.collect_set("zone")).alias("zones"))
