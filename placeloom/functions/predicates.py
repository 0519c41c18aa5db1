"""Relations of two places, and of a place and a post, as column expressions over named sides.

A side is a function from a field name to a column, for example lambda f: F.col("a_" + f). All id
comparisons are null-safe: two unknown ids count as equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.config import DEFAULT, Settings
from placeloom.operators.gazetteer import size_order
from placeloom.operators.spatial import haversine_m

Side = Callable[[str], Column]


def side(prefix: str) -> Side:
    return lambda f: F.col(prefix + f)


def is_near(a: Side, b: Side, settings: Settings = DEFAULT) -> Column:
    """Both towns, and less than near_m apart."""
    near = haversine_m(a("longitude"), a("latitude"), b("longitude"), b("latitude")) < settings.near_m
    return F.coalesce((a("type") == "town") & (b("type") == "town") & near, F.lit(False))


def is_family(a: Side, b: Side, a_name: Column, b_name: Column, continents: Callable[[Side], Column] | None = None, siblings: bool = True, by_length: bool = True, by_population: bool = False, settings: Settings = DEFAULT) -> Column:
    """Parent and child, or (with siblings) two places of a kind that belong together.

    continents gives the ids of the continents of a country side; without it no country belongs to one.
    """
    least = settings.family_min_population if by_population else 1
    if siblings:
        same = (
            F.when(a("type") == "town", (a("population") >= least) & (b("population") >= least) & is_near(a, b, settings))
            .when(a("type") == "adm1", a("country_geonameid").eqNullSafe(b("country_geonameid")))
            .otherwise(F.lit(True))
        )
    else:
        same = F.lit(False)
    first = size_order(a("type")) <= size_order(b("type"))

    def big(f: str) -> Column:
        return F.when(first, a(f)).otherwise(b(f))

    def small(f: str) -> Column:
        return F.when(first, b(f)).otherwise(a(f))

    child = big("geonameid").eqNullSafe(small("adm1_geonameid"))
    if by_length:
        inner = (F.length(a_name) >= settings.family_min_length) & (F.length(b_name) >= settings.family_min_length) & child
    else:
        inner = child | big("adm1_geonameid").eqNullSafe(small("adm1_geonameid"))
    over = F.array_contains(continents(small), big("geonameid")) if continents else F.lit(False)
    across = (
        F.when(big("type") == "continent", (small("type") == "country") & F.coalesce(over, F.lit(False)))
        .when(big("type") == "country", big("country_geonameid").eqNullSafe(small("country_geonameid")))
        .otherwise(inner)
    )
    return F.coalesce(F.when(a("type") == b("type"), same).otherwise(across), F.lit(False))


def matches_point(place: Side, lon: Column, lat: Column, areas: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a post's point supports a place: a continent or country (also a region's) area around it,
    a town less than near_m away. areas are the ids of the areas around the point."""
    near = haversine_m(lon, lat, place("longitude"), place("latitude")) < settings.near_m
    around = F.when(place("type") == "continent", F.array_contains(areas, place("geonameid"))).otherwise(F.array_contains(areas, place("country_geonameid")))
    return F.coalesce(F.when(place("type") == "town", near).otherwise(around), F.lit(False))


def matches_offset(place: Side, zones: Column, area_zones: Column) -> Column:
    """Whether one of the zones the post's offset allows is the place's own, or one of the area's."""
    own = F.array_contains(zones, place("time_zone"))
    return F.coalesce(F.when(place("type").isin("continent", "country"), F.arrays_overlap(zones, area_zones)).otherwise(own), F.lit(False))


def home_value(place: Side, home: Side, family: Column) -> Column:
    """1 where the place belongs to the author's home; of a country home, a smaller place's share of its
    population, at most 1; else 0. An unknown or empty home population gives 0."""
    share = F.coalesce(place("population") / F.nullif(home("population"), F.lit(0)), F.lit(0.0))
    return F.when(~family, 0.0).when((home("type") == "country") & (place("type") != "country"), F.least(share, F.lit(1.0))).otherwise(1.0)
