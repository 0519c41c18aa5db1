"""Finding posts by time and by the places already written to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(value: Column, start, end) -> Column:
    """Inclusive at both ends."""
    return (value >= F.lit(start)) & (value <= F.lit(end))


def _ids(ids: int | Iterable[int] | None) -> list[int]:
    return [] if ids is None else [ids] if isinstance(ids, int) else list(ids)


def has_location(locations: Column, countries=None, adm1=None) -> Column:
    """Whether locations hold any place, or one of the countries, or one in or of the adm1 regions.
    With both, the place's own id may be of either list, its region's only of adm1. Null gives false."""
    own, region = _ids(countries) + _ids(adm1), _ids(adm1)
    if not own:
        return F.coalesce(F.size(locations) > 0, F.lit(False))
    return F.coalesce(F.exists(locations, lambda x: F.coalesce(x["geonameid"].isin(own) | (x["adm1_geonameid"].isin(region) if region else F.lit(False)), F.lit(False))), F.lit(False))


def find_posts(posts: DataFrame, start, end, time: str = "posted_at", locations: bool = False, sort: bool = False, countries=None, adm1=None) -> DataFrame:
    """Posts of [start, end], optionally only those with (given) locations, optionally in order of time.
    All are plain predicates, so that they reach the scan."""
    found = posts.where(between(F.col(time), start, end))
    if locations or countries is not None or adm1 is not None:
        found = found.where(has_location(F.col("locations"), countries, adm1))
    return found.orderBy(time) if sort else found


def count_posts(posts: DataFrame, *args, **kwargs) -> int:
    return find_posts(posts, *args, **kwargs).count()
