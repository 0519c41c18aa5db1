"""The engine from posts to places on a small world, its streaming form, and the near-copy rules."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.config import Settings
from placeloom.functions.predicates import home_value, is_family, side
from placeloom.functions.timezones import intervals_table, offset_intervals, zones_of_posts
from placeloom.operators import candidates as ca
from placeloom.operators import gazetteer as gz
from placeloom.operators import home as hm
from placeloom.operators import resolve as rs
from placeloom.operators import similar_posts as sm
from placeloom.operators.search import find_posts, has_location

PLACES = [
    (1, "arland", "Arland", "A", "PCLI", 5_000_000, 5.0, 5.0, 1, None, "Etc/GMT-1"),
    (2, "westshire", "Westshire", "A", "ADM1", 400_000, 2.0, 5.0, 1, 2, "Etc/GMT-1"),
    (3, "oakport", "Oakport", "P", "PPL", 90_000, 2.1, 5.1, 1, 2, "Etc/GMT-1"),
    (4, "oakport", "Oakport", "P", "PPL", 8_000, 40.0, 40.0, 9, None, "Etc/GMT+3"),
    (5, "port", "Port", "P", "PPL", 20_000, 50.0, 10.0, 9, None, None),
    (6, "westshire", "Westshire", "P", "PPL", 30_000, 2.2, 5.2, 1, 2, "Etc/GMT-1"),
    (7, "new oakport", "New Oakport", "P", "PPL", 60_000, 2.3, 5.3, 1, 2, None),
    (8, "farm", "Farm", "P", "FRM", 9_000, 1.0, 1.0, 1, None, None),
]
ALTERNATES = [(10, 1, "abbr", "arl", "ARL"), (11, 3, "de", "eichhafen", "Eichhafen"), (12, 3, "link", "https://x", "https://x"), (13, 2, None, "westmark", "Westmark"), (14, 99, "en", "lost", "Lost")]


@pytest.fixture(scope="module")
def world(spark):
    places = spark.createDataFrame(PLACES, "geonameid int, name string, full_name string, feature_class string, feature_code string, population long, longitude double, latitude double, country_geonameid int, adm1_geonameid int, time_zone string")
    alternates = spark.createDataFrame(ALTERNATES, "alternatenameid int, geonameid int, isolanguage string, alternate_name string, full_name string")
    adm1 = spark.createDataFrame([(2, [[{"lon": 0.0, "lat": 4.0}, {"lon": 4.0, "lat": 4.0}, {"lon": 4.0, "lat": 6.0}, {"lon": 0.0, "lat": 6.0}]])], "geonameid int, rings array<array<struct<lon:double,lat:double>>>")
    return places, alternates, adm1, gz.build_gazetteer(places, alternates, adm1)


def test_gazetteer(world):
    places, alternates, adm1, gaz = world
    rows = {(r["name"], r["geonameid"]): r for r in gaz.collect()}
    assert set(rows) == {("arland", 1), ("arl", 1), ("westshire", 2), ("westmark", 2), ("oakport", 3), ("eichhafen", 3), ("oakport", 4), ("port", 5), ("westshire", 6), ("new oakport", 7)}
    assert rows["arl", 1]["abbreviations"] == ["ARL"] and rows["arl", 1]["languages"] == ["abbr"] and rows["westmark", 2]["languages"] == []
    assert rows["oakport", 3]["translations"] == 1 and rows["oakport", 3]["languages"] == ["general"]
    assert {r["geonameid"]: r["region"] for r in gz.fill_regions(places, adm1).collect()} == {1: None, 2: None, 3: 2, 4: None, 5: None, 6: 2, 7: 2, 8: None}
    assert [tuple(r)[:2] for r in ca.dominated(gaz).collect()] == [("westshire", 6)]


def posts(spark, rows):
    full = [(f"p{i}", datetime.fromisoformat(t), text, lang, False, (user, home, None, off), None, None) for i, (t, user, text, lang, home, off) in enumerate(rows)]
    return spark.createDataFrame(full, "post_id string, posted_at timestamp_ntz, text string, lang string, retweet boolean, author struct<id:bigint,location:string,time_zone:string,utc_offset:int>, coordinates struct<lon:double,lat:double>, bbox array<double>")


def test_country_table_and_overlapping_parts(spark):
    from placeloom.operators.spatial import points_in_regions

    square = lambda x: [[{"lon": x, "lat": 0.0}, {"lon": x + 4, "lat": 0.0}, {"lon": x + 4, "lat": 4.0}, {"lon": x, "lat": 4.0}]]
    rings = "array<array<struct<lon:double,lat:double>>>"
    info = spark.createDataFrame([(298795, "TR", "TUR", "AS", "tr", "turkey"), (7, "NA", "NAM", "AF", "en", "namibia")], "geonameid int, iso2 string, iso3 string, continent string, languages string, name string")
    outlines = spark.createDataFrame([("TR", square(0.0)), ("TR", square(10.0)), (None, square(50.0))], f"iso2 string, rings {rings}")
    got = {r["iso2"]: r for r in gz.country_table(info, outlines).collect()}
    assert got["TR"]["continents"] == [6255147, 6255148] and len(got["TR"]["rings"]) == 2
    assert got["NA"]["continents"] == [6255146] and got["NA"]["rings"] is None
    parts = gz.region_parts(spark.createDataFrame([(5, square(0.0)), (-5, square(2.0)), (0, square(0.0))], f"geonameid int, rings {rings}"))
    points = spark.createDataFrame([("a", 1.0, 1.0), ("both", 3.0, 1.0), ("b", 5.0, 1.0), ("out", 9.0, 1.0)], "id string, lon double, lat double")
    inside = points_in_regions(points, parts, "id", "lon", "lat", "geonameid", "rings").distinct()
    assert {tuple(r) for r in inside.collect()} == {("a", 5), ("both", 5), ("b", 5)}


def test_names_in_posts(spark, world):
    *_, gaz = world
    tags = spark.createDataFrame([("flood", "en")], "tag string, lang string")
    rows = [("2016-01-04T01:00:00", 1, "Water in New Oakport and Arland. port is dry", "en", None, None), ("2016-01-04T01:00:00", 1, "Oakport", "xx", None, None), ("2016-01-04T01:00:00", 1, None, "en", None, None), ("2016-01-04T01:00:00", 1, "#FloodOakport near Westshire", "en", None, None)]
    base = ca.base_posts(posts(spark, rows))
    none = spark.createDataFrame([], "lang string, word string")
    names = ca.found_names(ca.grams_of(base, tags), gaz, spark.createDataFrame([("arland",)], "name string"), none)
    got = {(r["post_id"], r["toponym"]): r for r in names.collect()}
    assert set(got) == {("p0", "new oakport"), ("p0", "arland"), ("p0", "port"), ("p3", "oakport"), ("p3", "westshire")}
    assert got["p0", "port"]["first_word"] and not got["p0", "arland"]["first_word"]
    able = {(r["toponym"], r["geonameid"]) for r in ca.candidates(names, gaz).collect()}
    assert able == {("new oakport", 7), ("arland", 1), ("port", 5), ("oakport", 3), ("oakport", 4), ("westshire", 2)}


HOMES = {
    "Oakport": {("oakport", 3)}, "Oakport, Arland": {("oakport", 3)}, "Arland": {("arland", 1)}, "Oakport Arland": {("oakport", 3)}, "Westshire/Arland": {("westshire", 2), ("arland", 1)}, "Oakport and Port": {("oakport", 3), ("port", 5)},
    "ARL": {("arl", 1)}, "arl": set(), "A.R.L.": {("arl", 1)}, "Nowhere": set(), "a, b, c, d": set(), "": set(), "Nowhere, Arland": {("arland", 1)}, "Oakport, Westshire, Arland": {("oakport", 3)},
}


def test_home_grammar(spark, world):
    places, alternates, adm1, gaz = world
    admin = gz.admin_names(places, alternates, adm1).withColumn("abbreviations", F.when(F.col("name") == "arl", F.col("abbreviations")).otherwise(F.array().cast("array<string>")))
    homes = spark.createDataFrame([(h,) for h in [*HOMES, None]], "home string")
    got = {h: set() for h in HOMES}
    for r in hm.home_places(homes, admin, gaz).collect():
        got[r["home"]].add((r["toponym"], r["geonameid"]))
    assert got == HOMES


def pair(spark, a, b, **how):
    fields = ("geonameid", "type", "population", "country_geonameid", "adm1_geonameid", "longitude", "latitude")
    kinds = "int, string, long, int, int, double, double".split(", ")
    schema = ", ".join(f"{p}{f} {k}" for p in ("a_", "b_") for f, k in zip(fields, kinds))
    df = spark.createDataFrame([(*a, *b)], schema)
    return df.select(is_family(side("a_"), side("b_"), F.lit(how.pop("an", "longname")), F.lit(how.pop("bn", "longname")), **how).alias("x")).first()["x"]


def test_family(spark):
    country, other, region, town = (1, "country", 9, 1, None, 0.0, 0.0), (8, "country", 9, 8, None, 0.0, 0.0), (2, "adm1", 9, 1, 2, 1.0, 1.0), (3, "town", 9000, 1, 2, 1.0, 1.0)
    far, lost = (4, "town", 9000, 7, None, 90.0, 1.0), (5, "town", 9000, None, None, 1.1, 1.0)
    assert pair(spark, country, town) and pair(spark, town, country) and not pair(spark, country, far)
    assert pair(spark, country, other) and not pair(spark, country, other, siblings=False)
    assert pair(spark, region, town) and not pair(spark, region, town, an="short") and pair(spark, region, town, an="short", by_length=False)
    assert pair(spark, town, lost) and not pair(spark, town, far) and not pair(spark, town, lost, siblings=False)
    assert not pair(spark, (9, "country", 9, None, None, 0.0, 0.0), town) and pair(spark, (9, "country", 9, None, None, 0.0, 0.0), lost)
    df = spark.createDataFrame([("town", 50, "country", 0), ("town", 50, "country", 100), ("town", 500, "town", 1)], "a_type string, a_population long, b_type string, b_population long")
    assert [r[0] for r in df.select(home_value(side("a_"), side("b_"), F.lit(True))).collect()] == [0.0, 0.5, 1.0]


SCORED = "post_id string, user_id long, posted_at timestamp_ntz, lang string, toponym string, original string, cut boolean, geonameid int, type string, population long, country_geonameid int, adm1_geonameid int, longitude double, latitude double, languages array<string>, abbreviations array<string>, s_coordinates double, s_home double, s_bbox double, s_family double, s_offset double"


def row(post, user, hour, place, kind="town", pop=10, country=1, name="x", original="X", langs=("general",), lang="en", cut=False, **s):
    at = datetime(2016, 1, 4) + timedelta(hours=hour)
    return (post, user, at, lang, name, original, cut, place, kind, pop, country, None, 0.0, 0.0, list(langs), [], *(float(s.get(k, 0)) for k in ("coordinates", "home", "bbox", "family", "offset")))


def elect(spark, rows, mode="as_written", texts=None):
    stepped = rs.in_steps(spark.createDataFrame(rows, SCORED), "2016-01-04 00:00:00", 1, 8)
    averaged = rs.average_scores(stepped, texts, Settings(family_mode=mode)).cache()
    return stepped, averaged, rs.elect(averaged)


def test_scores_truncate_and_count_users_once(spark):
    rows = [row("a", 1, 1, 5, offset=0.5), row("b", 2, 1, 5, offset=0.5), row("c", 3, 1, 5, offset=0.5), row("d", 3, 2, 5, offset=0.5, coordinates=2), row("e", 4, 2, 5, langs=("de",), coordinates=2)]
    _, averaged, _ = elect(spark, [r for r in rows if r[0] != "e"])
    got = averaged.where("step = 1").first()
    assert (got["users"], got["t_offset"], got["t_coordinates"], got["avg_score"]) == (3, 1, 2, 1.0)
    assert averaged.where("step = 4").count() == 1 and averaged.where("step = 5").count() == 0


def test_election(spark):
    rows = [row("a", 1, 1, 5, pop=10, coordinates=2), row("a", 1, 1, 6, pop=99, coordinates=2), row("a", 1, 1, 7, "adm1", 5, home=1)]
    _, _, won = elect(spark, rows)
    assert won.where("step = 1").first()["geonameid"] == 7
    _, _, won = elect(spark, [r if r[7] != 7 else row("a", 1, 1, 7, "adm1", 5, country=2, home=1) for r in rows])
    assert won.where("step = 1").first()["geonameid"] == 6
    _, _, won = elect(spark, rows + [row("a", 1, 1, 8, "country", 3), row("a", 1, 1, 9, "country", 4)])
    assert won.where("step = 1").first()["geonameid"] == 9
    _, _, won = elect(spark, [row("a", 1, 1, 5)])
    assert won.count() == 0


def test_boundary_posts_are_in_both_windows(spark):
    stepped = rs.in_steps(spark.createDataFrame([row("a", 1, 6, 5)], SCORED), "2016-01-04 00:00:00", 1, 8)
    assert sorted(r["step"] for r in stepped.collect()) == [1, 2, 3, 4, 5]


def test_placing_and_best(spark):
    rows = [row("a", 1, 1, 5, coordinates=2), row("a", 1, 1, 6, name="y", original="y", coordinates=2), row("b", 2, 8, 5, home=1), row("c", 3, 1, 5, lang="fr", langs=("en",))]
    stepped, averaged, won = elect(spark, rows)
    placed = rs.placed_posts(stepped, won)
    assert {(r["post_id"], r["toponym"]) for r in placed.collect()} == {("a", "x"), ("b", "x")}
    best = {r["post_id"]: (r["step"], r["avg_score"]) for r in rs.best_locations(placed).collect()}
    assert best["a"][0] == 1


def test_family_modes(spark):
    rows = [row("a", 1, 1, 5, family=3, bbox=2), row("b", 2, 1, 5, family=3)]
    texts = spark.createDataFrame([("a", "the same words here again"), ("b", "the same words here again")], "post_id string, text string")
    assert elect(spark, rows)[1].where("step = 1").first()["a_family"] == 1.0
    assert elect(spark, rows, "intended", texts)[1].where("step = 1").first()["a_family"] == 3.0


def test_near_copies(spark):
    t = datetime(2016, 1, 4)
    base = "water is high at the old bridge near the market and people are waiting there for help today"
    rows = [("g", "a", t, base), ("g", "b", t - timedelta(hours=1), base + " now"), ("g", "c", t, "nothing like the others at all"), ("g", "d", t + timedelta(hours=1), base), ("h", "e", t, base), ("h", "f", t, None), ("h", "g", t, "")]
    df = spark.createDataFrame(rows, "grp string, id string, at timestamp, text string")
    got = {(r["grp"], r["id"]) for r in sm.without_near_duplicates(df, "grp", "id", "at", "text", 0.2).collect()}
    assert got == {("g", "b"), ("g", "c"), ("h", "e"), ("h", "f"), ("h", "g")}
    pairs = spark.createDataFrame([("g", "a", "b"), ("g", "a", "c"), ("g", "c", "d"), ("g", "d", "e")], "grp string, a string, b string")
    # a, c and d have two neighbours each: a's star goes first, those of c, d and b meet it, and e's, left alone, holds d.
    stars = {(r["centre"], r["member"]) for r in sm.star_clusters(pairs, "grp").collect()}
    assert {s for s in stars if s[0] == "a"} == {("a", "a"), ("a", "b"), ("a", "c")}
    members = [m for _, m in stars]
    assert len(members) == len(set(members)) == 5
    assert sm.without_near_duplicates(df.limit(0), "grp", "id", "at", "text").count() == 0


def _posts_alike(n, groups, seed):
    """Texts of 12 to 16 words of few kinds of sentence; some are repeated with a word changed."""
    rng, t, rows = random.Random(seed), datetime(2016, 1, 4), []
    kinds = [[f"w{rng.randrange(200)}" for _ in range(13)] for _ in range(60)]
    for i in range(n):
        words = [w if rng.random() < 0.8 else f"v{rng.randrange(900)}" for w in rng.choice(kinds)] + [f"n{rng.randrange(50)}" for _ in range(rng.randrange(3))]
        if rows and rng.random() < 0.15:
            words = rng.choice(rows)[3].split(" ")
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((f"g{0 if rng.random() < 0.7 else rng.randrange(groups)}", f"p{i:05d}", t + timedelta(minutes=rng.randrange(600)), " ".join(words)))
    return rows


def _left_by_brute_force(rows, distance):
    """The rule of the near copies, one after the other, over all pairs."""
    left = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        own = [r for r in own if r[2] == min(x[2] for x in own if x[3] == r[3])]
        counts = [Counter((w := r[3].split(" ")) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for r in own]
        df = Counter(t for c in counts for t in c)
        terms = {t: i for i, t in enumerate(t for t, k in df.items() if len(own) <= 1000 or k >= int(math.log(len(own))))}
        m = np.zeros((len(own), len(terms)))
        for i, c in enumerate(counts):
            for t, tf in c.items():
                if t in terms:
                    m[i, terms[t]] = (1 + math.log(tf)) * (math.log((1 + len(own)) / (1 + df[t])) + 1)
        m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        close = 1 - m @ m.T < distance
        stars = sorted((-int(close[i].sum()), own[i][1], np.flatnonzero(close[i])) for i in range(len(own)) if close[i].sum() > 1)
        used, gone = set(), set()
        for _, _, star in stars:
            if not used & set(star):
                used |= set(star)
                gone |= set(star) - {min(star, key=lambda i: (own[i][2], own[i][1]))}
        left |= {(g, r[1]) for i, r in enumerate(own) if i not in gone}
    return left


@pytest.mark.parametrize("most", [None, 0])
def test_near_copies_as_by_brute_force(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(sm, "MAX_LETTERS", most)
    monkeypatch.setattr(sm, "ROWS_AT_ONCE", 100)
    rows = _posts_alike(1900 if most is None else 300, 5, 3)
    df = spark.createDataFrame(rows, "grp string, id string, at timestamp, text string")
    got = [(r["grp"], r["id"]) for r in sm.without_near_duplicates(df, "grp", "id", "at", "text", 0.2).collect()]
    assert len(got) == len(set(got)) < len(rows) and set(got) == _left_by_brute_force(rows, 0.2)


def test_near_copies_shuffle_little(spark):
    rows = _posts_alike(1500, 5, 4)
    df = spark.createDataFrame(rows, "grp string, id string, at timestamp, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    sm.without_near_duplicates(df, "grp", "id", "at", "text", 0.2).collect()
    assert shuffled() - before < 2 * sum(len(r[3]) for r in rows)


def test_zones(spark):
    spans = offset_intervals(["Europe/Amsterdam"], datetime(2016, 1, 1), datetime(2017, 1, 1))
    assert [(s[1], s[2]) for s in spans] == [(3600, datetime(2016, 1, 1)), (7200, datetime(2016, 3, 27, 1)), (3600, datetime(2016, 10, 30, 1))]
    df = spark.createDataFrame([("a", 3600, datetime(2016, 2, 1)), ("b", 3600, datetime(2016, 6, 1)), ("c", None, datetime(2016, 2, 1))], "post_id string, utc_offset int, posted_at timestamp_ntz")
    got = zones_of_posts(df, intervals_table(spark, ["Europe/Amsterdam", "Etc/GMT-1"], datetime(2016, 1, 1), datetime(2017, 1, 1)), "post_id", "utc_offset", "posted_at")
    assert {r["post_id"]: r["zones"] for r in got.collect()} == {"a": ["Etc/GMT-1", "Europe/Amsterdam"], "b": ["Etc/GMT-1"]}


def test_search(spark):
    loc = "array<struct<toponym:string,geonameid:int,adm1_geonameid:int>>"
    rows = [("a", datetime(2016, 1, 1), [("x", 1, 5)]), ("b", datetime(2016, 1, 2), [("x", 2, None)]), ("c", datetime(2016, 1, 3), []), ("d", datetime(2016, 1, 4), None)]
    df = spark.createDataFrame(rows, f"post_id string, posted_at timestamp, locations {loc}")
    ids = lambda d: "".join(sorted(r["post_id"] for r in d.collect()))
    lo, hi = F.lit("2016-01-01").cast("timestamp"), F.lit("2016-01-03").cast("timestamp")
    assert ids(find_posts(df, lo, hi)) == "abc" and ids(find_posts(df, lo, hi, locations=True)) == "ab"
    assert ids(find_posts(df, lo, hi, countries=2)) == "b" and ids(find_posts(df, lo, hi, adm1=5)) == "a" and ids(find_posts(df, lo, hi, countries=[2], adm1=[5])) == "ab"
    assert ids(df.where(has_location(F.col("locations")))) == "ab"


def test_stream_equals_batch(spark, tmp_path):
    from placeloom.streaming.engine import StreamingEngine

    rows = [row(f"p{i}", i % 5, i, 5 + i % 2, name=f"n{i % 3}", original="N", coordinates=2 * (i % 2), home=1) for i in range(0, 60)]
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], SCORED).coalesce(1).write.mode("append").parquet(folder)
    batch = rs.in_steps(spark.createDataFrame(rows, SCORED), "2016-01-04 00:00:00", 1, 9)
    setting = Settings(family_mode="as_written")
    want = {(r["post_id"], r["toponym"], r["geonameid"], r["avg_score"]) for r in rs.best_locations(rs.placed_posts(batch, rs.elect(rs.average_scores(batch, None, setting)))).collect()}
    engine = StreamingEngine(lambda df: df, datetime(2016, 1, 4), str(tmp_path / "state"), str(tmp_path / "store"), setting)
    stream = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(folder)
    engine.run(stream, str(tmp_path / "ck")).awaitTermination(120)
    last = spark.read.text(str(tmp_path / "store/current")).first()[0]
    got = {tuple(r) for r in spark.read.parquet(last).select("post_id", "toponym", "geonameid", "avg_score").collect()}
    assert engine.closed == 9 and got == want


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from placeloom.streaming.engine import StreamingEngine

    rows = [row(f"p{i}", i % 5, i, 5 + i % 2, name=f"n{i % 3}", original="N", coordinates=2 * (i % 2), home=1) for i in range(0, 60)]
    setting, commits = Settings(family_mode="as_written"), []

    def engine():
        return StreamingEngine(lambda df: df, datetime(2016, 1, 4), str(tmp_path / "state"), str(tmp_path / "store"), setting, commit=lambda best, step: commits.append((step, sorted(map(tuple, best.select("post_id", "toponym", "geonameid").collect())))))

    one = engine()
    one.take(spark.createDataFrame(rows[:30], SCORED), 0)
    assert one.closed > 0
    halfway, closed = list(commits), one.closed
    one.take(spark.createDataFrame(rows[30:], SCORED), 1)
    whole = list(commits)
    # The second batch is lost with its engine; another takes it again, and closes no step a second time.
    commits[:] = halfway
    two = engine()
    two.take(spark.createDataFrame(rows[30:], SCORED), 1)
    assert commits == whole and two.closed == one.closed and [s for s, _ in commits] == list(range(1, two.closed + 1)) and closed < two.closed


def test_spin_up_counts_in_the_first_windows(spark, tmp_path):
    from placeloom.streaming.engine import StreamingEngine

    setting, got = Settings(family_mode="as_written"), {}
    engine = StreamingEngine(lambda df: df, datetime(2016, 1, 4, 12), str(tmp_path / "state"), str(tmp_path / "store"), setting, commit=lambda best, step: got.update({step: {r["post_id"] for r in best.collect()}}), adapt=lambda df: df.withColumnRenamed("name", "toponym"))
    old = [row("early", 1, 1, 5, coordinates=2), row("late", 2, 11, 5, coordinates=2)]
    new = [row("new", 3, 13, 5, coordinates=2), row("end", 4, 40, 5, coordinates=2)]
    frames = [spark.createDataFrame(x, SCORED).withColumnRenamed("toponym", "name") for x in (old, new)]
    engine.spin_up(frames[0])
    engine.take(frames[1], 0)
    assert got[1] == {"early", "late", "new"} and min(got) == 1
