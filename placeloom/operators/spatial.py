"""Points in regions and points near points.

Regions are covered by an adaptive quadtree. Cells no ring edge touches are interior: a point in
one belongs to the region without further test. Cells at the last level that an edge touches are
boundary: only points in those get the exact even-odd test. Points near points use cubes of the
earth-centred space, which have no seam at the 180th meridian and no narrowing at the poles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import MAX_BROADCAST_ROWS, is_small

EARTH_RADIUS_M = 6_371_009.0
FIRST_LEVEL, LAST_LEVEL = 4, 11  #: cells of 360 / 2**level degrees: 22.5 to 0.18
SALTS = 16  #: copies of the smaller side where it is too large to broadcast


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; null when any coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bbox_centre(bbox: Column) -> Column:
    """struct<lon, lat> of the centre of a W, S, E, N array; E counts 360 more when W > E."""
    w, s, e, n = (bbox[i] for i in range(4))
    mid = (w + e + F.when(w > e, 360.0).otherwise(0.0)) / 2
    mid = F.when(mid > 180, mid - 360).otherwise(mid)
    whole = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
    return F.when(whole, F.struct(mid.alias("lon"), ((s + n) / 2).alias("lat")))


def valid_point(lon: Column, lat: Column) -> Column:
    """True for coordinates on the globe other than (0, 0)."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0)), F.lit(False))


def post_point(coordinates: Column, bbox: Column) -> Column:
    """A post's point: its coordinates when usable, else the centre of its bbox, else null."""
    lon, lat = coordinates["lon"], coordinates["lat"]
    return F.when(valid_point(lon, lat), F.struct(lon.alias("lon"), lat.alias("lat"))).otherwise(bbox_centre(bbox))


# --- regions -------------------------------------------------------------------------------


def ring_edges(rings: list) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all rings of a region; rings that aren't closed are closed."""
    out = []
    for ring in rings if rings is not None else ():
        pts = np.array([(p["lon"], p["lat"]) for p in ring if p is not None], float).reshape(-1, 2)
        if len(pts) > 1:
            out.append(np.hstack([pts, np.roll(pts, -1, axis=0)]))
    edges = np.vstack(out) if out else np.empty((0, 4))
    return edges[np.isfinite(edges).all(axis=1) & ((edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3]))]


def even_odd(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point is inside by the even-odd rule over all edges."""
    x1, y1, x2, y2 = edges.T[:, None, :]
    x, y = x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit.sum(axis=1) % 2 == 1


def _touched(edges: np.ndarray, x: np.ndarray, y: np.ndarray, size: float) -> np.ndarray:
    """Whether an edge touches each closed cell with the lower left corner (x, y)."""
    x1, y1, x2, y2 = edges.T[:, None, :]
    left, low = x[:, None], y[:, None]
    near = (np.minimum(x1, x2) <= left + size) & (np.maximum(x1, x2) >= left) & (np.minimum(y1, y2) <= low + size) & (np.maximum(y1, y2) >= low)
    side = [(x2 - x1) * (low + b - y1) - (y2 - y1) * (left + a - x1) for a in (0, size) for b in (0, size)]
    apart = (np.minimum.reduce(side) > 0) | (np.maximum.reduce(side) < 0)
    return (near & ~apart).any(axis=1)


def cover_region(edges: np.ndarray, last_level: int = LAST_LEVEL) -> list[tuple[int, int, int, bool]]:
    """Cells (level, column, row, interior) that together cover the region."""
    if not len(edges):
        return []
    size = 360 / 2**FIRST_LEVEL
    span = [np.arange(math.floor((edges[:, [i, i + 2]].min() + o) / size), math.floor((edges[:, [i, i + 2]].max() + o) / size) + 1) for i, o in ((0, 180), (1, 90))]
    cx, cy = (a.ravel() for a in np.meshgrid(*span))
    out = []
    for level in range(FIRST_LEVEL, last_level + 1):
        size = 360 / 2**level
        x, y = cx * size - 180, cy * size - 90
        touched = _touched(edges, x, y, size)
        free = ~touched
        if free.any():
            inside = even_odd(edges, x[free] + size / 2, y[free] + size / 2)
            out += [(level, int(a), int(b), True) for a, b in zip(cx[free][inside], cy[free][inside])]
        cx, cy = cx[touched], cy[touched]
        if level == last_level:
            out += [(level, int(a), int(b), False) for a, b in zip(cx, cy)]
        else:
            cx, cy = (np.concatenate([2 * c + i for i in shift]) for c, shift in ((cx, (0, 1, 0, 1)), (cy, (0, 0, 1, 1))))
    return out


def cell_key(level: Column, column: Column, row: Column) -> Column:
    return F.shiftleft(level.cast("long"), 48) + F.shiftleft(column.cast("long"), 24) + row.cast("long")


def region_cover(regions: DataFrame, region_id: str, rings: str, last_level: int = LAST_LEVEL) -> DataFrame:
    """(region, cell, interior): the cells of every region. Regions without rings have none."""
    kind = regions.schema[region_id].dataType.simpleString()

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, shapes = batch.column(0), batch.column(1).to_pylist()
            cells = [(i, *c) for i, g in enumerate(shapes) for c in cover_region(ring_edges(g), last_level)]
            at, level, cx, cy, interior = zip(*cells) if cells else [()] * 5
            cols = [regions.take(pa.array(at, pa.int64())), *(pa.array(v, pa.int32()) for v in (level, cx, cy)), pa.array(interior, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["region", "level", "cx", "cy", "interior"])

    cells = regions.select(F.col(region_id).alias("region"), F.col(rings).alias("rings")).where("region is not null").mapInArrow(covers, f"region {kind}, level int, cx int, cy int, interior boolean")
    return cells.select("region", cell_key(F.col("level"), F.col("cx"), F.col("cy")).alias("cell"), "interior")


def inside_rings(rings: Column, lon: Column, lat: Column) -> Column:
    """Exact even-odd test of a point against all rings, as a JVM expression."""

    def crossings(ring: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
            at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
            return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), lambda n, i: n + crosses(i))

    return F.aggregate(F.filter(rings, lambda r: F.size(r) > 1), F.lit(0), lambda n, ring: n + crossings(ring)) % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str, lon: str, lat: str, region_id: str, rings: str, last_level: int = LAST_LEVEL, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(point_id, region_id) for every point inside a region.

    Points with a null, NaN or off-globe coordinate and regions without rings give no row; equal
    rows of `points` give equal rows of output; other columns of either input are ignored. The
    cover is broadcast when its counted size allows it; a larger one is joined by shuffle, salted
    so that a cell with many points is spread over SALTS tasks.
    """
    pts = points.select(F.col(point_id).alias("_p"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    pts = pts.where(F.col("_x").between(-180, 180) & F.col("_y").between(-90, 90))
    cover = region_cover(regions, region_id, rings, last_level)

    def cell(level: int) -> Column:
        size = 360 / 2**level
        return cell_key(F.lit(level), F.floor((F.col("_x") + 180) / size), F.floor((F.col("_y") + 90) / size))

    keyed = pts.withColumn("cell", F.explode(F.array(*(cell(k) for k in range(FIRST_LEVEL, last_level + 1)))))
    if is_small(cover, max_broadcast_rows):
        met = keyed.join(F.broadcast(cover), "cell")
    else:
        salted = cover.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"])
    shapes = regions.select(F.col(region_id).alias("region"), F.col(rings).alias("_g")).where("region is not null")
    shapes = F.broadcast(shapes) if is_small(shapes, 20_000) else shapes
    sure = met.where("interior").select("_p", "region")
    doubtful = met.where("not interior").join(shapes, "region").where(inside_rings(F.col("_g"), F.col("_x"), F.col("_y"))).select("_p", "region")
    return sure.unionByName(doubtful).select(F.col("_p").alias(point_id), F.col("region").alias(region_id))


# --- points near points --------------------------------------------------------------------


def _xyz(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [EARTH_RADIUS_M * F.cos(a) * F.cos(b), EARTH_RADIUS_M * F.cos(a) * F.sin(b), EARTH_RADIUS_M * F.sin(a)]


def points_near_points(points: DataFrame, others: DataFrame, point_id: str, lon: str, lat: str, other_id: str, other_lon: str, other_lat: str, metres: float, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(point_id, other_id) for every pair less than `metres` apart on the great circle.

    Space is cut into cubes of edge 2 * metres: a point looks in its own cube only, while an
    other is filed under each of the at most 8 cubes its ball meets. Null and off-globe
    coordinates give no row; other columns are ignored; repeated rows give repeated pairs.
    """
    edge, offset = 2.0 * metres, 1 << 20
    if EARTH_RADIUS_M / edge >= offset:
        raise ValueError("metres is too small for 21-bit cube numbers")

    def key(cube: list[Column]) -> Column:
        x, y, z = ((c + offset).cast("long") for c in cube)
        return F.shiftleft(x, 42) + F.shiftleft(y, 21) + z

    def usable(df: DataFrame, i: str, x: str, y: str, to: list[str]) -> DataFrame:
        df = df.select(F.col(i).alias(to[0]), F.col(x).cast("double").alias(to[1]), F.col(y).cast("double").alias(to[2]))
        return df.where(F.col(to[1]).between(-180, 180) & F.col(to[2]).between(-90, 90))

    pts = usable(points, point_id, lon, lat, ["_p", "_x", "_y"])
    pts = pts.withColumn("cube", key([F.floor(c / edge) for c in _xyz(F.col("_x"), F.col("_y"))]))
    oth = usable(others, other_id, other_lon, other_lat, ["_o", "_ox", "_oy"])
    for axis, c in zip("abc", _xyz(F.col("_ox"), F.col("_oy"))):
        reach = metres * (1 + 1e-9)
        oth = oth.withColumn(axis, F.explode(F.array_distinct(F.array(F.floor((c - reach) / edge), F.floor((c + reach) / edge)))))
    oth = oth.select("_o", "_ox", "_oy", key([F.col(a) for a in "abc"]).alias("cube"))
    if is_small(oth, max_broadcast_rows):
        met = pts.join(F.broadcast(oth), "cube")
    else:
        salted = oth.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = pts.withColumn("salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int")).join(salted, ["cube", "salt"])
    near = haversine_m(F.col("_x"), F.col("_y"), F.col("_ox"), F.col("_oy")) < metres
    return met.where(near).select(F.col("_p").alias(point_id), F.col("_o").alias(other_id))
