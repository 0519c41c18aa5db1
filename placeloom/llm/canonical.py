"""Freely typed values mapped to the entries of a reference list (problem 3).

A value is brought to plain form and cut into places, the areas given after them and the words
around them. Every stretch of words that isn't longer than the longest listed name may be typed is a key;
each distinct key is looked up once in BK-trees over the folded reference names, broadcast while their
counted number allows it, else one tree set for each shard of names, met by blocks of the keys of near
lengths, whose winners are merged. Codes are found by equality. From the hits a value's places are chosen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.bktree import BKForest
from placeloom.llm.plain import TO_LATIN, lookalikes, plain, use
from placeloom.session import broadcast_if_small, cut, is_small

MISTAKES = 2  #: single-character mistakes allowed in a name
NAMES_PER_SHARD = 200_000  #: names that one set of trees may hold
KEYS_PER_BLOCK = 100_000  #: keys of a length that one task looks up in a shard

# Words that stand before or after a place without belonging to its name.
AROUND = frozenset(
    "in from near at living live lives based born now currently formerly originally ex old around outside close to the city town of area region greater "
    "de en cerca desde vivo viviendo près pres à a dans depuis habite vers aus bei nahe im der die das wohne lebe in da di del vicino vivo abito "
    "perto em do moro morando no na uit te bij nabij woon dari dekat tinggal ke yakın yaşıyor из у код близу живим my home here via between "
    "north south east west downtown central".split()
)
# Letters without a canonical decomposition, and how they are typed plainly.
PLAIN_LETTERS = str.maketrans({"ı": "i", "ø": "o", "œ": "oe", "æ": "ae", "ß": "ss", "đ": "d", "ł": "l", "ð": "d", "þ": "th", "ħ": "h"})
BETWEEN_PLACES = re.compile(r"\s*(?:[/&+;|→]|<->|\s-\s|\s(?:and|und|y|et|e|en|dan|ve|и|&amp;|then|or|to)\s)\s*", re.IGNORECASE)
BEFORE_AREA = re.compile(r"\s*[,，(\[{)\]}]\s*")
TOKEN = re.compile(r"[^\W_]+(?:['’`][^\W_]+)*")


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """The key of a name: plain form, lower case, no accents, letters and digits only."""
    low = unicodedata.normalize("NFKD", (plain(text) or "").lower().translate(PLAIN_LETTERS))
    return "".join(c for c in low if c.isalnum())


def _keys(part: str, longest: int) -> list[tuple[str, int, int]]:
    """(key, foreign words left out, words left out) of every stretch of words of a part with at most `longest`
    letters, and of the whole part."""
    words = TOKEN.findall(part)
    folded = [fold(w) for w in words]
    foreign = [0]
    for w in words:
        foreign.append(foreign[-1] + (w.lower() not in AROUND))
    out = {}

    def add(i: int, j: int, key: str) -> None:
        rank = (foreign[-1] - (foreign[j] - foreign[i]), len(words) - (j - i))
        if key and (key not in out or rank < out[key]):
            out[key] = rank

    add(0, len(words), "".join(folded))
    for i in range(len(words)):
        key = ""
        for j in range(i + 1, len(words) + 1):
            key += folded[j - 1]
            if len(key) > longest:
                break
            add(i, j, key)
    alike = "".join(TO_LATIN.get(c, c) for c in part)
    if alike != part and (key := fold(alike)) not in out:
        out[key] = (0, 0)
    return [(k, *r) for k, r in out.items()]


@lru_cache(1 << 14)
def readings(value: str, longest: int) -> tuple[list, list[tuple[list, list[list]]], list[list]]:
    """(keys of the whole value, [(keys of a place, keys of each area after it)], keys of hyphenated parts)."""
    text = re.sub(r"https?://\S+|[@#]", " ", plain(value) or "")
    places = []
    for chunk in BETWEEN_PLACES.split(text):
        bits = [b for b in BEFORE_AREA.split(chunk or "") if b and TOKEN.search(b)]
        if bits:
            places.append((_keys(bits[0], longest), [_keys(b, longest) for b in bits[1:]]))
    hyphened = [_keys(b, longest) for b in text.split("-") if TOKEN.search(b)] if text.count("-") == 1 else []
    return _keys(text, longest), places, hyphened


def all_keys(value: str, longest: int) -> set[str]:
    whole, places, hyphened = readings(value, longest)
    return {k[0] for part in (whole, *hyphened, *(p for p, _ in places), *(a for _, areas in places for a in areas)) for k in part}


class Hits:
    """Hits of a value's keys: key -> [(mistakes, (id, is area, population, areas it lies in, kind))]."""

    def __init__(self, told: str | None):
        self.by_key: dict[str, list] = {}
        for line in (told or "").split("\n"):
            if line:
                key, far, gid, area, pop, inside, code = line.split("|")
                self.by_key.setdefault(key, []).append((int(far), (int(gid), area == "1", int(pop), {int(x) for x in inside.split(",") if x}, int(code))))

    def best(self, part: list, places_only: bool = True) -> tuple[tuple, list] | None:
        """(rank, entries) of the best stretch of a part. Rank: foreign words left out, mistakes, words left out.
        Of a key the entries with the fewest mistakes count, among those that may be meant at all."""
        found = None
        for key, foreign, left in part:
            able = [(far, e) for far, e in self.by_key.get(key, ()) if e[4] < 2 or not places_only]
            mistakes = min((far for far, _ in able), default=0)
            entries = [e for far, e in able if far == mistakes]
            if not entries or foreign and len(key) < (5 if mistakes == 0 else 8) or mistakes * 3 > len(key) + 1:
                continue
            rank = (foreign, mistakes, left, -len(key))
            if found is None or rank < found[0]:
                found = (rank, entries)
        return found


def choose(entries: list, areas: list[set[int]]) -> int | None:
    """The most populous entry among those that lie in the areas; each area counts only if it leaves any."""
    for wanted in areas:
        inside = [e for e in entries if wanted & e[3]]
        entries = inside or entries
    return max(entries, key=lambda e: (e[2], -e[0]))[0] if entries else None


def resolve(value: str, told: str | None, longest: int) -> list[int]:
    """The ids a value means, none where it means no listed entry."""
    hits = Hits(told)
    whole, places, hyphened = readings(value, longest)
    entire = hits.best([k for k in whole if k[1] == 0])
    if entire and entire[0][1] == 0:
        return [choose(entire[1], [])]
    out: list[int] = []
    for place, areas in places:
        got = hits.best(place)
        if not got:
            continue
        wanted, beside = [], []
        for part in areas:
            area = hits.best(part, places_only=False)
            if area and any(e[1] or e[4] for e in area[1]):
                wanted.append({e[0] for e in area[1] if e[1] or e[4]})
            elif area and area[0][0] == 0:
                beside.append(area[1])
        out += [choose(got[1], wanted), *(choose([e for e in b if e[4] < 2], []) for b in beside)]
    if out and (len(places) > 1 or places[0][1] or not entire):
        if len(places) == 1 and len(hyphened) == 2 and (parts := [hits.best([k for k in h if k[1] == 0]) for h in hyphened]) and all(parts):
            return list(dict.fromkeys(choose(p[1], []) for p in parts))
        return [x for x in dict.fromkeys(out) if x is not None]
    return [choose(entire[1], [])] if entire else []


def nearest_names(keys: DataFrame, names: DataFrame, mistakes: int = MISTAKES, names_per_shard: int = NAMES_PER_SHARD, keys_per_block: int = KEYS_PER_BLOCK) -> DataFrame:
    """(key, name, mistakes): of each distinct key the names nearest to it, if within `mistakes`.

    Up to names_per_shard names are broadcast as one set of trees, and the keys spread over all tasks. More are
    cut into shards by length and hash. Each key goes to the shards of the lengths it can match, cut into
    blocks there, so that no task holds more than a shard of names and a block of keys; the winners of the
    shards are merged by least distance.
    """

    def search(trees: BKForest, ks: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(ks[i], n, d) for i, n, d in trees.nearest(ks, mistakes)], columns=["key", "name", "mistakes"])

    spark = keys.sparkSession
    names = names.select("name").distinct()
    if is_small(names, names_per_shard):
        listed = spark.sparkContext.broadcast(sorted(r["name"] for r in names.collect()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees = BKForest(listed.value)
            for pdf in batches:
                yield search(trees, pdf["key"].tolist())

        return keys.repartition(spark.sparkContext.defaultParallelism, "key").mapInPandas(run, "key string, name string, mistakes int")
    keys = cut(keys.distinct())
    shards, blocks = -(-names.count() // names_per_shard), -(-keys.count() // keys_per_block)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(1, n))).cast("int")
    left = keys.withColumn("block", part("key", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = left.withColumn("length", F.explode(F.sequence(F.length("key") - mistakes, F.length("key") + mistakes)))
    right = names.withColumn("shard", part("name", shards)).withColumn("length", F.length("name")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))

    def both(ks: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        return search(BKForest(ns["name"].tolist()), ks["key"].tolist()) if len(ks) and len(ns) else search(BKForest([]), [])

    by = ["length", "shard", "block"]
    met = cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(both, "key string, name string, mistakes int"))
    least = met.groupBy("key").agg(F.min("mistakes").alias("mistakes"))
    return met.join(least, ["key", "mistakes"]).select("key", "name", "mistakes")


def map_values(values: DataFrame, value: str, entries: DataFrame, names_per_shard: int = NAMES_PER_SHARD) -> DataFrame:
    """(value, id): one row for each entry a distinct value means, id null where it means none.

    entries: (label string, id int, is_area boolean, population long, inside array<int>, kind int);
    kind 0 is a name, 1 a code that is found without mistakes only, 2 a code of an area that only
    tells places apart. Null and blank values give no row.
    """
    spark = values.sparkSession
    table = spark.sparkContext.broadcast(lookalikes(spark))

    def folding(s: pd.Series) -> pd.Series:
        use(table.value)
        return s.map(lambda x: fold(x) if x else None)

    listed = entries.where("label is not null").withColumn("name", F.pandas_udf(folding, "string")("label")).where("name <> ''")
    told = F.concat_ws("|", F.lit(""), F.col("id"), F.col("is_area").cast("int"), F.coalesce(F.col("population"), F.lit(0)), F.array_join(F.col("inside").cast("array<string>"), ","), F.col("kind"))
    listed = cut(listed.groupBy("name", (F.col("kind") > 0).alias("code")).agg(F.collect_set(told).alias("told")))
    longest = (listed.agg(F.max(F.length("name"))).first()[0] or 0) + MISTAKES

    def keying(s: pd.Series) -> pd.Series:
        use(table.value)
        return s.map(lambda x: sorted(all_keys(x, longest)))

    def meaning(v: pd.Series, t: pd.Series) -> pd.Series:
        use(table.value)
        return pd.Series([resolve(a, b, longest) for a, b in zip(v, t)], dtype=object)

    asked = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S")).distinct()
    cut_up = cut(asked.repartition(spark.sparkContext.defaultParallelism, "value").withColumn("key", F.explode_outer(F.pandas_udf(keying, "array<string>")("value"))))
    keys = cut_up.where("key is not null").select("key").distinct()
    near = nearest_names(keys, listed.where("not code"), names_per_shard=names_per_shard).withColumn("code", F.lit(False))
    codes = keys.join(broadcast_if_small(listed.where("code").select(F.col("name").alias("key"))), "key", "left_semi").select("key", F.col("key").alias("name"), F.lit(0).alias("mistakes"), F.lit(True).alias("code"))
    hits = near.unionByName(codes).join(broadcast_if_small(listed), ["name", "code"]).withColumn("one", F.explode("told"))
    hits = hits.groupBy("key").agg(F.concat_ws("\n", F.collect_list(F.concat(F.col("key"), F.lit("|"), F.col("mistakes"), F.col("one")))).alias("told"))
    gathered = cut_up.join(hits, "key", "left").groupBy("value").agg(F.concat_ws("\n", F.collect_list("told")).alias("told"))
    return gathered.select("value", F.explode_outer(F.pandas_udf(meaning, "array<int>")("value", "told")).alias("id"))
