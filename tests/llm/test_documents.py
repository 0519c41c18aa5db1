import random

import pytest
from pyspark.sql import functions as F

from placeloom.llm import packing, tokens, truncation
from placeloom.llm.mixing import mix_sources


def test_pack_is_valid_and_tight():
    rng = random.Random(1)
    for top in (100, 40, 10):
        sizes = [rng.randint(0, top) for _ in range(500)] + [0, 0]
        place, used = packing.pack(sizes, 100)
        load = {}
        for s, p in zip(sizes, place):
            load[p] = load.get(p, 0) + s
        assert max(load.values()) <= 100 and all(0 <= p < used for p in place) and len(load) == used
        assert used <= 1.25 * max(1, -(-sum(sizes) // 100)) + sum(s > 50 for s in sizes) * 0.3
    assert packing.pack([], 10) == ([], 0) and packing.pack([0], 10) == ([0], 1)
    assert packing.pack([60, 40, 50, 50], 100)[1] == 2


def test_pack_documents(spark):
    rng = random.Random(2)
    docs = [(i, rng.randint(0, 90)) for i in range(300)] + [(1000, 950), (1001, 200), (1002, None), (1002, 5)]
    df = spark.createDataFrame(docs, "id int, size int").withColumn("piece", F.lit(1))
    caps = spark.createDataFrame([("small", 100), ("large", 400), ("bad", 0), (None, 50)], "kind string, cap int")
    rows = packing.pack_documents(df, caps.where("kind is not null"), "id", "size", "kind", "cap", shard_rows=100).collect()
    for kind, cap in (("small", 100), ("large", 400)):
        own = [r for r in rows if r["kind"] == kind]
        load, whole = {}, {}
        for r in own:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
            whole[r["id"]] = whole.get(r["id"], 0) + r["tokens"]
            assert r["pieces"] == 1 or whole[r["id"]] and r["first_token"] == r["piece"] * cap
        assert max(load.values()) <= cap
        assert whole == {i: sum((s or 0) for j, s in docs if j == i) for i, _ in docs}
        assert all(r["pieces"] == max(1, -(-(dict(docs[:-2])[r["id"]]) // cap)) for r in own if r["id"] < 1002)
    assert {r["kind"] for r in rows} == {"small", "large"}
    assert packing.pack_documents(df.limit(0), caps, "id", "size", "kind", "cap").count() == 0


def test_token_counts(spark):
    text = "High water in Oakport, déjà vu. " * 3
    whole = len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(text * 400))
    assert sum(len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(p)) for p in tokens.pieces(text * 400, 1000)) == whole
    assert "".join(tokens.pieces(text * 40, 100)) == text * 40
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert {r["id"]: r["tokens"] for r in tokens.with_tokens(df, ["id"], "text").collect()} == {1: tokens.count_tokens(text), 2: 0, 3: 0}


def test_mix_sources(spark):
    rng = random.Random(3)
    docs = [(i, "big", rng.randint(50, 150)) for i in range(4000)] + [(i + 9000, "small", rng.randint(50, 150)) for i in range(150)] + [(20001, None, 5), (20002, "spare", 7), (20003, "big", None)]
    df = spark.createDataFrame(docs, "id int, source string, size int").withColumn("copies", F.lit(1))
    goal = spark.createDataFrame([("r", "big", 0.7, 1), ("r", "small", 0.3, 4), ("r", "none", 0.0, 1), ("s", "big", 1.0, 2), ("t", "absent", 0.5, 2), ("t", "small", 0.5, 2)], "recipe string, source string, share double, most int")
    mix, report = mix_sources(df, goal, "id", "source", "size", "recipe", "share", "most")
    rows, told = mix.collect(), {(r["recipe"], r["source"]): r for r in report.collect()}
    most = {("r", "big"): 1, ("r", "small"): 4, ("s", "big"): 2, ("t", "small"): 2}
    assert all(1 <= r["copies"] <= most[r["recipe"], r["source"]] for r in rows)
    assert len({(r["recipe"], r["id"]) for r in rows}) == len(rows)
    for key in (("r", "big"), ("r", "small")):
        assert told[key]["actual_share"] == pytest.approx(told[key]["target_share"], abs=0.01)
        assert told[key]["tokens"] == sum(r["tokens"] * r["copies"] for r in rows if (r["recipe"], r["source"]) == key)
    assert told["t", "absent"]["tokens"] == 0 and told["t", "small"]["actual_share"] == 1.0
    over, short = mix_sources(df, goal.where("recipe = 'r'"), "id", "source", "size", "recipe", "share", "most", total=10**7)
    assert over.agg(F.max(F.when(F.col("source") == "small", F.col("copies")))).first()[0] == 4
    assert {r["source"]: r["actual_share"] < r["target_share"] for r in short.collect()} in ({"big": False, "small": True}, {"big": True, "small": False})
    assert mix_sources(df.limit(0), goal, "id", "source", "size", "recipe", "share", "most")[0].count() == 0


COMPLETE = [
    "The river rose in the night. The road is closed.", "The road is closed. #flood", "The road is closed! https://t.example/ab1", "The road is closed. 🌊 👷‍♀️", "The road is closed.\n— Oakport desk",
    '"The road is closed."', "The road is closed. (own report)", "High water in Oakport", "The road is closed. ...!", "", "The bridge is shut. #mokgt",
]
CUT = ["The river rose in the night. The road is clo", "The river rose in the night. The road…", "The river rose in the night. The road is...", "The river rose. The bridge is sh &am", "The river rose. The br�", "The river rose in the night. The road ", "The river rose. Then the road, the bridge [...]", "The road is closed, and"]


def test_truncation(spark):
    filler = [f"High water in Place{i}\nThe river rose in the night. The road is closed and the bridge is shut." for i in range(6)]
    texts = COMPLETE + CUT + filler
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "The road is clo", None), (902, "word " * 50_000 + "end.", "b"), (902, "word " * 50_000 + "end.", "b")]
    df = spark.createDataFrame(rows, "id int, text string, src string").withColumn("truncated", F.lit(3))
    got = truncation.find_truncated(df, "id", "text", "src").collect()
    assert len(got) == len(rows)
    flagged = {r["id"] for r in got if r["truncated"]}
    assert flagged == {i for i, t in enumerate(texts) if t in CUT} | {901}
    assert {r["id"]: r["unknown_prefix"] for r in got}[len(COMPLETE)] is True
    assert truncation.find_truncated(df.limit(0), "id", "text", "src").count() == 0


def test_cut_headline_is_told_by_its_final_token(spark):
    filler = [f"High water in Place{i}\nThe river rose in Oakport. The road is closed." for i in range(6)]
    texts = [*filler, "High water in Oakp", "High water in Oakport", "High water in Elmford"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "id int, text string, src string")
    got = {texts[r["id"]]: r for r in truncation.find_truncated(df, "id", "text", "src").collect()}
    assert {t for t, r in got.items() if r["truncated"]} == {"High water in Oakp"}
    assert got["High water in Oakp"]["headline"] and not got["High water in Oakp"]["at_limit"]


def test_length_limits_are_spikes(spark):
    rows = [("wire", 1200)] * 40 + [("wire", 39_914), ("wire", 1500), *(("wire", 900 + i) for i in range(300))] + [("relay", 160)] * 20 + [("relay", 159)] * 3 + [("relay", 100 + i % 50) for i in range(100)]
    rows += [("free", 100 + i % 20) for i in range(400)]
    df = spark.createDataFrame(rows, "src string, n int").select("src", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    assert {r["_source"]: r["limit"] for r in truncation.length_limits(df, "text", "src").collect()} == {"wire": 1200, "relay": 160}
    got = truncation.find_truncated(df.withColumn("n", F.length("text")), "n", "text", "src").where("at_limit").select("src", "n").distinct().collect()
    assert {tuple(r) for r in got} == {("wire", 1200), ("wire", 1199), ("relay", 160), ("relay", 159)}
