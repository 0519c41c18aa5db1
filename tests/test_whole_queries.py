"""Registered queries on a small folder of tables, against brute force."""

from collections import Counter
from datetime import datetime

import pytest

from placeloom.plans.engine_queries import QUERIES
from tests.test_spatial import metres

POST = "post_id string, posted_at timestamp, text string, lang string, retweet boolean, author struct<id:bigint,location:string,time_zone:string,utc_offset:int>, coordinates struct<lon:double,lat:double>, bbox array<double>"
POSTS = [
    ("p1", "Water rises here", "en", False, (5.0, 5.0)),
    ("p2", "Water rises there", "en", None, (5.5, 5.5)),
    ("p3", "Water komt hier", "nl", False, (30.0, 1.0)),
    ("p4", "Water rises", "en", True, None),
    ("p5", "rises", None, False, (200.0, 1.0)),
]
TOWNS = [(1, "P", 2_000_000, 5.1, 5.0), (2, "P", 900, 5.2, 5.1), (3, "P", None, 30.1, 1.0), (4, "P", 0, 60.0, 1.0), (5, "A", 5_000_000, 5.0, 5.0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    posts = [(i, datetime(2016, 1, 4), t, lang, again, (1, None, None, None), at, None) for i, t, lang, again, at in POSTS]
    spark.createDataFrame([*posts, posts[0]], POST).write.parquet(f"{path}/posts.parquet")
    spark.createDataFrame(TOWNS, "geonameid int, feature_class string, population long, longitude double, latitude double").write.parquet(f"{path}/geonames.parquet")
    for name in ("alternate_names", "adm1", "countries", "most_common_words"):
        spark.createDataFrame([], "geonameid int").write.parquet(f"{path}/{name}.parquet")
    return path


def test_towns_of_any_population_are_near(spark, folder):
    want = sorted((p[0], t[0]) for p in POSTS if p[4] and abs(p[4][0]) <= 180 for t in TOWNS if t[1] == "P" and metres(p[4], t[3:]) < 200_000)
    assert {t for _, t in want} == {1, 2, 3}
    assert sorted(map(tuple, QUERIES["op_j13_all_towns"](spark, folder).collect())) == want


def test_ngrams_of_all_languages_and_of_one_post(spark, folder):
    want = Counter()
    for _, text, lang, again, _ in POSTS:
        w = text.split()
        want.update(() if again else {(lang, " ".join(w[i:j])) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 3) + 1)})
    got = {(r["lang"], r["gram"]): r["posts"] for r in QUERIES["op_s16_all_ngrams"](spark, folder).collect()}
    assert got == want and got["nl", "komt"] == 1 and got["en", "Water rises"] == 2
