import struct

from pyspark.sql import functions as F

from placeloom.sources import files, shapes, sinks


def test_tsv_nulls_and_skips(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("# head\n#x\nNA\t1.0\tq\"uote\n\tNaN\tnan\nTR\tx\tlast\n", encoding="utf-8")
    rows = files.read_tsv(spark, str(p), ["iso", "n", "t"], {"n": "long"}, skip_lines=2).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("NA", 1, 'q"uote'), (None, None, None), ("TR", None, "last")], key=str)
    rows = files.read_tsv(spark, str(p), ["iso", "n", "t"], {"n": "long"}, keep=["n"], comment="#").collect()
    assert sorted(r["n"] or 0 for r in rows) == [0, 0, 1]


def test_small_files(spark, tmp_path):
    (tmp_path / "tags").write_text("su taşkın, tr\nflood, en\n", encoding="utf-8")
    assert sorted(map(tuple, files.read_tags(spark, str(tmp_path / "tags")).collect())) == [("flood", "en"), ("sutaşkın", "tr")]
    (tmp_path / "w").write_text("the 5\nof 4\nand 3\n")
    assert sorted(map(tuple, files.read_word_ranks(spark, str(tmp_path / "w"), "en", 2).collect())) == [(1, "en", "the"), (2, "en", "of")]
    (tmp_path / "z").write_text("#c\nNA\t+1\tAfrica/Windhoek\textra\n")
    assert [tuple(r) for r in files.read_country_zones(spark, str(tmp_path / "z")).collect()] == [("NA", "Africa/Windhoek")]
    sheet = spark.createDataFrame([("a", "b"), ("c", None)], "`1` string, `2` string")
    assert sorted(map(tuple, files.unpivot_zones(sheet).collect())) == [(1, "a"), (1, "c"), (2, "b")]


def write_shape(folder):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    (folder / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"ID".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15
    (folder / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 1, 1, 1, 1, 32 + 32 + 1, 5) + b"\0" * 20 + field + b"\r" + b" 0042")


def test_shapes(spark, tmp_path):
    write_shape(tmp_path)
    shapes.register(spark)
    row = spark.read.format("shapes").load(str(tmp_path)).first()
    assert row["fields"] == '{"ID": "0042"}' and row["bbox"] == [0.0, 0.0, 2.0, 2.0] and len(row["rings"][0]) == 4
    df = spark.createDataFrame([("MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))",), ("nonsense(",), (None,)], "w string").select(shapes.rings_of_wkt(F.col("w")).alias("r"))
    got = df.select("r", shapes.ring_box(F.col("r")).alias("b"), shapes.rings_of_wkt(shapes.wkt_of_rings(F.col("r"))).alias("again")).collect()
    assert got[0]["b"] == [0.0, 0.0, 6.0, 6.0] and got[0]["again"] == got[0]["r"]
    geo = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}',), ("{",)], "g string").select(shapes.rings_of_geojson(F.col("g")).alias("r")).collect()
    assert len(geo[0]["r"][0]) == 4 and geo[1]["r"] is None
    assert shapes.children_of_xml("<x><geoname><geonameId>5</geonameId><name>A</name></geoname></x>") == [(5, "A")]


def test_upsert_keeps_the_better(spark, tmp_path):
    schema = "post_id string, toponym string, geonameid int, avg_score double"
    path = str(tmp_path / "store")
    sinks.upsert_locations(spark, path, spark.createDataFrame([("p", "a", 1, 0.5), ("p", "b", 2, 0.5)], schema), 1)
    last = sinks.upsert_locations(spark, path, spark.createDataFrame([("p", "a", 3, 0.5), ("p", "b", 4, 0.6), ("q", "a", 5, 0.1)], schema), 2)
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [("p", "a", 1, 0.5), ("p", "b", 4, 0.6), ("q", "a", 5, 0.1)]
    docs = sinks.location_documents(spark.read.parquet(last)).where("post_id = 'p'").first()["locations"]
    assert [d["toponym"] for d in docs] == ["a", "b"]


def test_gazetteer_dumps(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1\tÇam\tCam\t\t38.5\t27.1\tP\tPPL\tNA\t\t07\t\t\t\t1200\t\t5\tEurope/Istanbul\t2016-01-01\n", encoding="utf-8")
    r = files.read_places(spark, str(tmp_path / "p.txt")).first()
    assert (r["geonameid"], r["name"], r["country"], r["admin1_code"], r["population"], r["latitude"]) == (1, "çam", "NA", "07", 1200, 38.5)
    (tmp_path / "a.txt").write_text("9\t1\ttr\tÇAM\t1\t\t\t\n10\t1\t\tCam\t\t\t\t\n", encoding="utf-8")
    assert sorted(map(tuple, files.read_alternates(spark, str(tmp_path / "a.txt")).collect())) == [(9, 1, "tr", "ÇAM", "çam"), (10, 1, None, "Cam", "cam")]
    (tmp_path / "c.txt").write_text("# x\nNA\tNAM\t516\tWA\tNamibia\tWindhoek\t1\t2\tAF\t.na\tNAD\tDollar\t264\t\t\ten,af\t3355338\tZA\t\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_country_info(spark, str(tmp_path / "c.txt")).collect()] == [(3355338, "NA", "NAM", "AF", "en,af", "namibia")]
    (tmp_path / "l.csv").write_text("language_code,capital\nen,1\nxx,0\n")
    assert sorted(map(tuple, files.read_languages(spark, str(tmp_path / "l.csv")).collect())) == [("en", True), ("xx", False)]


def test_a_lost_job_leaves_the_last_whole_version(spark, tmp_path):
    schema, path = "post_id string, toponym string, geonameid int, avg_score double", str(tmp_path / "store")
    sinks.upsert_locations(spark, path, spark.createDataFrame([("p", "a", 1, 0.5)], schema), 1)
    (tmp_path / "store" / "v00000002").mkdir()  # begun, never finished
    import shutil

    shutil.rmtree(tmp_path / "store" / "current")
    for _ in range(2):  # and a version written again is the same
        last = sinks.upsert_locations(spark, path, spark.createDataFrame([("p", "a", 2, 0.6), ("q", "a", 3, 0.1)], schema), 2)
        assert {tuple(r)[:3] for r in spark.read.parquet(last).collect()} == {("p", "a", 2), ("q", "a", 3)}


def test_posts_of_another_form(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "7", "body": "water"}\n')
    got = files.read_posts(spark, str(tmp_path / "x.json"), "json", lambda df: df.select(F.col("id").alias("post_id"), F.col("body").alias("text")), "id string, body string")
    assert [tuple(r) for r in got.collect()] == [("7", "water")]
