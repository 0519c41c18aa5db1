from pyspark.sql import functions as F

from placeloom.functions import dates, text as tx


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_clean_text(spark):
    clean = lambda t: one(spark, t, lambda c: tx.clean_text(c, lower=False))
    assert clean("RT @user: Bow_Wow #FloodInNewYork http://t.co/x &amp; more") == ": Bow Wow Flood In New York & more"
    assert clean("@josé l'eau") == "l eau"
    assert clean("") == ""
    assert clean(None) is None
    assert one(spark, "&eacute;t&eacute;", lambda c: tx.clean_text(c, full_entities=True)) == "été"


def test_tokens_and_ngrams(spark):
    assert one(spark, "Paris, France... new-york 12", lambda c: tx.tokenize(c, remove_punctuation=True)) == ["Paris", "France", "...", "new-york", "12"]
    grams = one(spark, "Paris, France... York 12", lambda c: tx.without_digits(tx.ngrams(tx.tokenize(c, remove_punctuation=True), 1, 3)))
    assert set(grams) == {"Paris", "France", "York", "Paris France"}
    assert one(spark, "", lambda c: tx.ngrams(tx.tokenize(c), 1, 3)) == []


def test_strip_tags(spark):
    got = one(spark, "x", lambda c: tx.strip_tags(F.array(F.lit("Great Flood York"), F.lit("flood"), F.lit("Rome")), F.array(F.lit("floods"), F.lit("flood"))))
    assert [tuple(r) for r in got] == [("Great York", True), ("Rome", False)]


def test_case_and_first_words(spark):
    for text, want in (("New York", True), ("New york", False), ("NEW", False), ("12", False), ("Çamlı", True)):
        assert one(spark, text, tx.is_title) is want
    assert one(spark, "Rome floods. York? no: Oslo", tx.sentence_first_words) == ["rome", "york", "no", "oslo"]
    assert one(spark, "New York", tx.all_parts_upper) and not one(spark, "New york", tx.all_parts_upper)


def test_helpers(spark):
    assert one(spark, "Ćafé", tx.to_ascii) == "Cafe"
    assert one(spark, "sooooo", tx.reduce_repeats) == "soo"
    assert one(spark, "HELP Me", tx.capitals_to_title) == "Help Me"
    assert one(spark, "no!!! yes", tx.single_punctuation) == "no! yes"
    assert str(one(spark, "2016-01-04T10:20:30", dates.iso_to_time)) == "2016-01-04 10:20:30"
    assert one(spark, "nonsense", dates.iso_to_time) is None
    assert dates.daterange(spark, "2016-01-04 00:00:00", "2016-01-05 00:00:00", 6).count() == 4
