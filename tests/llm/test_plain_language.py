import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from placeloom.llm import language as lg
from placeloom.llm import text_queries
from placeloom.llm.plain import lookalikes, plain, plain_forms, unstable_pattern

CASES = {
    "Ｉｖｙ ｌａｎｅ": "Ivy lane",
    "h​oldin​g": "holding",
    "a b　c": "a b c",
    "café": "café",
    "sandbаgs bеhind": "sandbags behind",
    "Росо dopo le dieci": "Poco dopo le dieci",
    "oни пocле су били": "они после су били",
    "ﬂats": "flats",
    "\U0001d430\U0001d41a\U0001d42f\U0001d41e": "wave",
    "ɡսո": "gun",
}
SAME = ["naïve Çam Pıibal œur ß", "а о у Серији је на путу", "Los hombres (Шиљевац) van", "👨‍👩‍👧 ❤️ 1️⃣ 🏳️‍🌈 👷‍♀️", "Αθήνα", "1½ … ™ &amp; ª", "", "plain", "https://x.example/а​ ok", "Бране &amp; на"]


@pytest.mark.parametrize("text", CASES)
def test_plain_changes(text):
    assert plain(text) == CASES[text]
    assert plain(CASES[text]) == CASES[text]


@pytest.mark.parametrize("text", SAME)
def test_plain_keeps(text):
    assert plain(text) == text


def test_plain_forms_on_rows(spark):
    rows = [(1, "h​i"), (2, None), (3, ""), (4, "long " * 20_000 + "ｅｎｄ"), (1, "h​i"), (5, "ok")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("plain", F.lit("clash"))
    got = sorted(((r["id"], r["plain"]) for r in plain_forms(df, ["id"], "text").collect()), key=str)
    assert got == sorted([(1, "hi"), (2, None), (3, ""), (4, "long " * 20_000 + "end"), (1, "hi"), (5, "ok")], key=str)
    assert {r["id"] for r in plain_forms(df, ["id"], "text", only_changed=True).collect()} == {1, 4}
    assert plain_forms(df.limit(0), ["id"], "text").count() == 0


def test_every_composable_character_is_composed():
    wrong = []
    for ch in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x40000))):
        apart = unicodedata.normalize("NFD", ch)
        if apart != ch and unicodedata.category(ch)[0] not in "Z":
            text = f"blue {apart} dog"
            if plain(text) != unicodedata.normalize("NFC", text):
                wrong.append(ch)
    # These have a compatibility form, or look like a Latin letter and stand alone.
    assert wrong == ["ϓ", "ϔ", "ẛ", chr(0x1FBE)]


def test_placeholders_in_the_text_are_text():
    assert plain("\x01 https://x.example/a @b é \x00 Ａ") == "\x01 https://x.example/a @b é \x00 A"
    assert plain("ｶﾞ and \u1112\u1161\u11ab") == "ガ and 한"


def test_public_lookalikes(spark):
    table = lookalikes(spark)
    assert table["г"] == "r" and table["Ꮇ"] == "M" and len(table) > 200
    df = spark.createDataFrame([(1, "the гiver roѕe"), (2, "горе и доле"), (3, "the гора")], "id int, text string")
    assert {r["id"]: r["plain"] for r in plain_forms(df, ["id"], "text").collect()} == {1: "the river rose", 2: "горе и доле", 3: "the гора"}


def test_quick_check_finds_all_changes(spark):
    texts = list(CASES) + SAME
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flagged = {r["t"] for r in df.where(F.col("t").rlike(unstable_pattern())).collect()}
    assert {t for t in texts if plain(t) != t} <= flagged


SENTENCES = {
    "en": "the river has risen again and the people in the street are waiting for help",
    "es": "el río ha subido otra vez y la gente de la calle espera todavía la ayuda",
    "de": "der fluss ist wieder gestiegen und die leute in der straße warten auf hilfe",
    "fr": "la rivière est encore montée et les gens de la rue attendent toujours du secours",
    "it": "il fiume è salito ancora e la gente della strada aspetta gli aiuti da ieri",
    "nl": "de rivier is weer gestegen en de mensen in de straat wachten nog altijd op hulp",
    "pt": "o rio subiu outra vez e as pessoas da rua ainda esperam pela ajuda desde ontem",
    "id": "sungai naik lagi dan orang orang di jalan masih menunggu bantuan sejak kemarin",
    "tr": "nehir yine yükseldi ve sokaktaki insanlar dünden beri hâlâ yardım bekliyor",
    "sr": "река је опет порасла и људи на улици још увек чекају помоћ од јуче",
}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for lang, text in SENTENCES.items():
        w = text.split()
        for _ in range(n):
            out.append((" ".join(rng.choices(w, k=12)) + ".", lang))
    return out


def test_codebook_corrects_errors():
    code = lg.codebook()
    apart = [(code[i] != code[j]).sum() for i in range(len(code)) for j in range(i)]
    assert min(apart) >= 5 and len(code) == len(lg.LANGUAGES)


def test_held_out_accuracy_in_spite_of_wrong_labels(spark):
    train = corpus(60, 1)
    train = [(t, "en" if i % 13 == 0 else lang) for i, (t, lang) in enumerate(train)]
    model = lg.fit_languages(spark.createDataFrame(train, "text string, lang string"), "text", "lang")
    test = [(str(i), t, lang) for i, (t, lang) in enumerate(corpus(10, 2))]
    test += [("mix", test[0][1] + " " + test[30][1], "x"), ("none", "🌊 https://t.example/x #tag", "x"), ("empty", "", "x"), ("null", None, "x"), ("long", test[5][1] * 2000, "en")]
    df = spark.createDataFrame(test, "id string, text string, truth string").withColumn("segments", F.lit(1))
    got = {r["id"]: r for r in lg.label_languages(df.drop("segments"), ["id", "truth"], "text", model).collect()}
    right = sum(bool(r["segments"]) and r["segments"][0]["lang"] == r["truth"] for i, r in got.items() if i.isdigit())
    assert right >= 0.95 * 100
    assert {s["lang"] for s in got["mix"]["segments"]} == {test[0][2], test[30][2]}
    assert got["none"]["segments"] == got["empty"]["segments"] == got["null"]["segments"] == []
    assert got["long"]["segments"][0]["lang"] == "en"
    assert lg.label_languages(df.limit(0), ["id"], "text", model).count() == 0


def test_language_codes(spark):
    want = {"en": "en", "EN": "en", "en-US": "en", "spa": "es", "in": "id", "sr-Cyrl": "sr", "": None, " ": None, "und": None, "zxx": None, "unknown": None, "ru": "other", None: None}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r["l"]: r["c"] for r in df.select("l", lg.language_code(F.col("l")).alias("c")).collect()} == want


def test_every_run_of_sentences_has_a_segment(spark, tmp_path):
    en, es = SENTENCES["en"].capitalize() + ".", SENTENCES["es"].capitalize() + "."
    texts = {"runs": f"{en} {en} {es} {en}", "short": "the river has risen", "tail": f"{es} the people are waiting.", "none": "🌊 https://t.example/x", "null": None}
    rows = [(str(i), t, lang) for i, (t, lang) in enumerate(corpus(40, 1))] + [(i, t, None) for i, t in texts.items()] + [("short", texts["short"], None)]
    spark.createDataFrame(rows, "post_id string, text string, lang string").write.parquet(f"{tmp_path}/posts.parquet")
    got = {}
    for r in text_queries.p5_segments(spark, str(tmp_path)).orderBy("post_id", "first").collect():
        got.setdefault(r["post_id"], []).append(r)
    runs = {i: [(r["lang"], r["first"], r["last"]) for r in got[i]] for i in texts}
    assert runs["runs"] == [("en", 0, 1), ("es", 2, 2), ("en", 3, 3)]
    assert runs["short"] == [("en", 0, 0)] and 0 < got["short"][0]["confidence"] <= 0.8
    assert runs["tail"] == [("es", 0, 0), ("en", 1, 1)] and got["tail"][1]["confidence"] <= 0.8
    assert [tuple(r)[1:3] for i in ("none", "null") for r in got[i]] == [(None, None)] * 2
    assert len(got) == 400 + len(texts)
