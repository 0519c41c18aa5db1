"""Near-duplicate posts within groups by TF-IDF vectors: exact pairs and disjoint star clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions.text import DUPLICATE_TOKEN
from placeloom.operators.near_vectors import kept_of_groups
from placeloom.session import cut

#: A group of texts up to so many letters in all is worked out by one task.
MAX_LETTERS = 45_000_000
#: Small groups are worked out together, about so many rows at once.
ROWS_AT_ONCE = 20_000


def earliest_of_text(rows: DataFrame, group: str, time: str, text: str) -> DataFrame:
    """Rows whose time is the least of their text in the group; equal times are all kept."""
    first = rows.groupBy(F.col(group), F.col(text)).agg(F.min(time).alias("_first"))
    return rows.join(first, [group, text]).where(F.col(time) == F.col("_first")).drop("_first")


def vectors(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, terms): terms is an array of struct<df, term, weight>, rarest first, of unit length.

    Terms are tokens and pairs of neighbours; the weight is (1 + ln tf) (ln((1 + n) / (1 + df)) + 1).
    In groups of more than 1000 rows terms in fewer than ln n rows are left out.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    tokens = F.regexp_extract_all(F.col(text), F.lit(DUPLICATE_TOKEN), 0)
    seen = rows.select(group, key, tokens.alias("_t"))
    pairs = F.when(F.size("_t") > 1, F.zip_with(F.expr("slice(_t, 1, size(_t) - 1)"), F.expr("slice(_t, 2, size(_t) - 1)"), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    terms = seen.select(group, key, F.explode(F.concat("_t", pairs)).alias("term")).groupBy(group, key, "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy(group, "term").agg(F.count("*").alias("df")).join(size, group)
    df = df.where((F.col("_n") <= 1000) | (F.col("df") >= F.floor(F.log(F.col("_n")))))
    weighed = terms.join(df, [group, "term"]).withColumn("weight", (1 + F.log("tf")) * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    whole = weighed.groupBy(group, key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_len"), F.array_sort(F.collect_list(F.struct("df", "term", "weight"))).alias("_v"))
    return whole.select(group, key, F.transform("_v", lambda x: F.struct(x["df"], x["term"], (x["weight"] / F.col("_len")).alias("weight"))).alias("terms"))


def near_pairs(vecs: DataFrame, group: str, key: str, distance: float) -> DataFrame:
    """(group, a, b) with a < b: pairs of cosine distance under `distance`. Two such vectors share one of
    the terms before the point where what follows is shorter than the least similarity."""
    least = 1 - distance
    rest = F.aggregate("terms", F.struct(F.lit(1.0).alias("left"), F.lit(0).alias("n")), lambda s, x: F.when(s["left"] >= least * least - 1e-9, F.struct((s["left"] - x["weight"] * x["weight"]).alias("left"), (s["n"] + 1).alias("n"))).otherwise(s))
    keyed = vecs.select(group, key, F.explode(F.slice("terms", F.lit(1), rest["n"])).alias("x")).select(group, key, "x.term")
    left, right = keyed.select(group, F.col(key).alias("a"), "term"), keyed.select(group, F.col(key).alias("b"), "term")
    met = left.join(right, [group, "term"]).where("a < b").select(group, "a", "b").distinct()
    maps = vecs.select(group, key, F.map_from_arrays(F.transform("terms", lambda x: x["term"]), F.transform("terms", lambda x: x["weight"])).alias("m"))
    both = met.join(maps.withColumnsRenamed({key: "a", "m": "ma"}), [group, "a"]).join(maps.withColumnsRenamed({key: "b", "m": "mb"}), [group, "b"])
    dot = F.aggregate(F.map_keys("ma"), F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at("ma", t) * F.try_element_at("mb", t), F.lit(0.0)))
    return both.where(1 - dot < distance).select(group, "a", "b")


def star_clusters(pairs: DataFrame, group: str) -> DataFrame:
    """(group, centre, member): disjoint stars, the largest first, of equal ones that of the least centre.

    The choice one by one is made in rounds: a star is taken as soon as it comes first among all stars
    that hold any of its members; stars that meet a taken one are out.
    """
    links = pairs.select(group, F.col("a").alias("centre"), F.col("b").alias("member")).unionByName(pairs.select(group, F.col("b").alias("centre"), F.col("a").alias("member")))
    own = links.select(group, "centre", F.col("centre").alias("member")).distinct()
    stars = links.unionByName(own)
    size = stars.groupBy(group, "centre").agg((-F.count("*")).alias("_o"))
    live, taken = cut(stars.join(size, [group, "centre"])), None
    while live.limit(1).count():
        first = live.groupBy(group, "member").agg(F.min(F.struct("_o", "centre")).alias("_f"))
        judged = live.join(first, [group, "member"]).withColumn("_ok", F.col("_f.centre") == F.col("centre"))
        won = cut(judged.groupBy(group, "centre").agg(F.bool_and("_ok").alias("_all")).where("_all").join(live, [group, "centre"]).select(group, "centre", "member"))
        taken = won if taken is None else taken.unionByName(won)
        hit = live.join(won.select(group, "member"), [group, "member"], "left_semi").select(group, "centre").distinct()
        live = cut(live.join(hit, [group, "centre"], "left_anti"))
    return taken if taken is not None else stars.select(group, "centre", "member").limit(0)


def _in_groups(batches: Iterator[pa.RecordBatch], distance: float) -> Iterator[pa.RecordBatch]:
    """(group, key) of what is left of rows (group, key, time, tokens) that come group by group; tokens are null for null texts."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_pylist()
        starts = [i for i, name in enumerate(names) if name != (names[i - 1] if i else last)]
        if held and starts and sum(x.num_rows for x in held) + starts[-1] >= ROWS_AT_ONCE:
            held.append(batch.slice(0, starts[-1]))
            batch = batch.slice(starts[-1])
            yield from _left_of(held, distance)
        held.append(batch)
        last = names[-1]
    if held:
        yield from _left_of(held, distance)


def _left_of(held: list[pa.RecordBatch], distance: float) -> Iterator[pa.RecordBatch]:
    """(group, key) of what is left of whole groups; empties `held`, so that the tokens are in memory once."""
    rows = pa.Table.from_batches(held)
    held.clear()
    bare = rows.filter(pc.is_null(rows.column(3))).select([0, 1])
    rows = rows.filter(pc.is_valid(rows.column(3))) if bare.num_rows else rows
    names = rows.column(0).to_pylist()
    group = np.cumsum([i > 0 and name != names[i - 1] for i, name in enumerate(names)], dtype=np.int64)
    del names
    ranks = []
    for by in ([1], [2, 1]):
        order = pc.sort_indices(rows, sort_keys=[(rows.column_names[c], "ascending") for c in by]).to_numpy()
        ranks.append(np.empty(len(order), np.int64))
        ranks[-1][order] = np.arange(len(order))
    tokens, rows = rows.column(3), rows.select([0, 1])
    ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())]).astype(np.int64)
    tokens = [np.concatenate([np.empty(0, np.uint64), *(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in tokens.chunks)])]
    pa.default_memory_pool().release_unused()
    left = kept_of_groups(ptr, tokens, group, *ranks, distance)
    yield from pa.concat_tables([rows.filter(pa.array(left)), bare]).group_by(rows.column_names).aggregate([]).to_batches()


def without_near_duplicates(rows: DataFrame, group: str, key: str, time: str, text: str, distance: float = 0.2) -> DataFrame:
    """(group, key): what is left when of each star of near duplicates only the earliest row is kept (of
    equal times the least key), after all but the earliest copies of equal texts are out. Null texts
    are no duplicates of anything.

    One task holds a group of up to MAX_LETTERS of text and works it out alone; larger groups go through shuffles."""
    rows = cut(rows.select(group, key, time, text), release=True)
    large = rows.groupBy(group).agg(F.sum(F.length(text) + 1).alias("_letters")).where(F.col("_letters") > MAX_LETTERS).select(group)
    large = [r[0] for r in large.collect()]
    is_large = F.coalesce(F.col(group).isin(large), F.lit(False))
    kept = _of_small_groups(rows.where(~is_large), group, key, time, text, distance)
    return kept.unionByName(_of_large_groups(rows.where(is_large), group, key, time, text, distance)) if large else kept


def _of_small_groups(rows: DataFrame, group: str, key: str, time: str, text: str, distance: float) -> DataFrame:
    first = F.min(time).over(Window.partitionBy(group, text))
    rows = rows.repartition(group).withColumn("_first", first).where(F.col(text).isNull() | (F.col(time) == F.col("_first")))
    tokens = F.transform(F.regexp_extract_all(F.col(text), F.lit(DUPLICATE_TOKEN), 0), lambda x: F.xxhash64(x))
    rows = rows.sortWithinPartitions(group).select(group, key, time, tokens.alias("tokens"))
    return rows.mapInArrow(lambda batches: _in_groups(batches, distance), rows.select(group, key).schema)


def _of_large_groups(rows: DataFrame, group: str, key: str, time: str, text: str, distance: float) -> DataFrame:
    first = cut(earliest_of_text(rows.where(F.col(text).isNotNull()), group, time, text))
    stars = star_clusters(near_pairs(vectors(first, group, key, text), group, key, distance), group)
    kept = stars.withColumnRenamed("member", key).join(first.select(group, key, time), [group, key])
    kept = kept.groupBy(group, "centre").agg(F.min(F.struct(time, key)).alias("_f")).select(group, F.col("_f")[key].alias(key))
    alone = first.select(group, key).join(stars.select(group, F.col("member").alias(key)), [group, key], "left_anti")
    return alone.unionByName(kept).unionByName(rows.where(F.col(text).isNull()).select(group, key)).distinct()
