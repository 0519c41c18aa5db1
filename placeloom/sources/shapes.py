"""Polygon files and texts: a reader of .shp and .dbf pairs as a data source, WKT and GeoJSON as columns."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RINGS = "array<array<struct<lon:double,lat:double>>>"


def _records(dbf: bytes) -> Iterator[dict]:
    count, head, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    for i in range(count):
        pos, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = dbf[pos : pos + width].decode("utf-8", "replace").strip()
            pos += width
        yield row


def _polygons(shp: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    at = 100
    while at < len(shp):
        length = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + length]
        kind = struct.unpack("<i", body[:4])[0]
        rings: list = []
        if kind in (5, 15, 25):
            parts, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
        elif kind in (1, 11, 21):
            rings = [[struct.unpack("<dd", body[4:20])]]
        yield rings
        at += 8 + length


class ShapeFile(DataSource):
    """spark.read.format("shapes").load(folder or file): one row for each shape of each .shp file, with its
    fields as JSON, its rings and its bounding box. Files are read in parallel, a file in one task."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return f"file string, fields string, rings {RINGS}, bbox array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        path = Path(options["path"])
        self.files = sorted(path.rglob("*.shp")) if path.is_dir() else [path]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(f)) for f in self.files]

    def read(self, partition: InputPartition):
        path = Path(partition.value)
        table = path.with_suffix(".dbf")
        fields = list(_records(table.read_bytes())) if table.exists() else []
        for i, rings in enumerate(_polygons(path.read_bytes())):
            flat = [p for r in rings for p in r]
            box = [min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat)] if flat else None
            yield str(path), json.dumps(fields[i] if i < len(fields) else {}, ensure_ascii=False), [[{"lon": x, "lat": y} for x, y in r] for r in rings], box


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapeFile)


def _wkt_rings(text: str) -> list:
    rings = re.findall(r"\(([^()]+)\)", text)
    return [[{"lon": float(p.split()[0]), "lat": float(p.split()[1])} for p in r.split(",")] for r in rings]


def _geojson_rings(text: str) -> list:
    shape = json.loads(text)
    shape = shape.get("geometry", shape)
    parts = {"Polygon": [shape.get("coordinates")], "MultiPolygon": shape.get("coordinates"), "Point": [[[shape.get("coordinates")]]]}.get(shape.get("type"), [])
    return [[{"lon": float(x[0]), "lat": float(x[1])} for x in ring] for part in parts for ring in part]


def _parse(f):
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return f(t) if t else None
            except (ValueError, IndexError, TypeError, AttributeError):
                return None

        return s.map(one)

    return run


def rings_of_wkt(text: Column) -> Column:
    """Rings of POLYGON and MULTIPOLYGON texts; null for what isn't one."""
    return F.pandas_udf(_parse(_wkt_rings), RINGS)(text)


def rings_of_geojson(text: Column) -> Column:
    return F.pandas_udf(_parse(_geojson_rings), RINGS)(text)


def wkt_of_rings(rings: Column) -> Column:
    """MULTIPOLYGON text with every ring a polygon of its own."""
    ring = F.transform(rings, lambda r: F.concat(F.lit("(("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit("))")))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(ring, ", "), F.lit(")"))


def ring_box(rings: Column) -> Column:
    """W, S, E, N of all rings."""
    flat = F.flatten(rings)
    lon, lat = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    return F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat))


def children_of_xml(text: str) -> list[tuple[int, str]]:
    """(geonameid, name) of the children in an answer of a place service."""
    import xml.etree.ElementTree as ET

    return [(int(g.findtext("geonameId")), g.findtext("name") or "") for g in ET.fromstring(text).iter("geoname") if g.findtext("geonameId")]
