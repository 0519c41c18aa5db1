"""Filling containers of fixed capacity with documents (problem 6).

Documents above one third of the capacity can share a container with at most one other such
document, unless three just fit: they are matched greedily, the largest with the largest that
still fits. Smaller documents then go into the remaining gaps by best fit. Packing runs in shards of bounded
size, spread by hash, so that no task holds all documents and the waste of a shard is a few
containers at most. Only a document longer than the capacity is split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small

SHARD_ROWS = 20_000  #: documents a shard aims at
KINDS_PER_ROW, TURNS_PER_ROW = 100, 10_000  #: kinds of container, and repeats of a document, that one row holds at a time


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(container number of each item, number of containers). No size may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    place, gaps, used = [-1] * len(sizes), [], 0
    large = [i for i in order if 3 * sizes[i] > capacity]
    rising = large[::-1]
    keys, taken = [sizes[i] for i in rising], [False] * len(rising)
    below = list(range(-1, len(rising) - 1))  # next untaken item at or under a position, as a union-find

    def free(k: int) -> int:
        path = []
        while k >= 0 and taken[k]:
            path.append(k)
            k = below[k]
        for p in path:
            below[p] = k
        return k

    for pos in range(len(rising) - 1, -1, -1):
        if taken[pos]:
            continue
        taken[pos] = True
        place[rising[pos]] = used
        gap = capacity - keys[pos]
        mate = free(min(pos, bisect_right(keys, gap)) - 1)
        if mate >= 0:
            taken[mate] = True
            place[rising[mate]] = used
            gap -= keys[mate]
        gaps.append((gap, used))
        used += 1
    gaps.sort()
    for i in order[len(large) :]:
        if sizes[i] == 0 and not gaps:
            gaps.append((capacity, used))
            used += 1
        k = bisect_left(gaps, (sizes[i], -1))
        if k == len(gaps):
            gap, bin_ = capacity, used
            used += 1
        else:
            gap, bin_ = gaps.pop(k)
        place[i] = bin_
        insort(gaps, (gap - sizes[i], bin_))
    return place, used


def pack_documents(sized: DataFrame, containers: DataFrame, key: str, size: str, kind: str, capacity: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(kind, container, key, piece, pieces, first_token, tokens): where each document goes.

    A document of at most the capacity is one piece. A longer one gives full pieces, each alone
    in its container, and a rest packed like a document. Null sizes count as 0; documents of 0
    tokens are placed too. Kinds of null or non-positive capacity are left out. Repeated rows are
    packed as often as they stand there. A container's name tells its shard, or the split document and piece.
    """
    kinds = containers.select(F.col(kind).alias("_kind"), F.col(capacity).cast("long").alias("_cap")).where("_cap > 0").distinct()
    rows = sized.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    shards = max(1, -(-rows.count() // shard_rows))
    # Repeats of a key are told apart by their turn, the same one on every attempt.
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {TURNS_PER_ROW}"))).alias("_lot")
    turns = F.explode(F.expr(f"sequence(_lot * {TURNS_PER_ROW} + 1, least((_lot + 1) * {TURNS_PER_ROW}, count))")).alias("_turn")
    rows = rows.groupBy("_key", "_size").count().select("*", lots).select("_key", "_size", turns)
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_key", "_turn", F.lit(3)), F.lit(shards)).cast("int"))
    # Every document goes to every kind; the kinds lie in a few rows, each row's in an array.
    last = (max(1, kinds.count()) - 1) // KINDS_PER_ROW
    listed = kinds.groupBy(F.pmod(F.xxhash64("_kind"), F.lit(last + 1)).alias("_lot")).agg(F.collect_list(F.struct("_kind", "_cap")).alias("_kinds"))
    pieces = rows.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(broadcast_if_small(listed), "_lot")
    pieces = pieces.select("_key", "_size", "_turn", "_shard", F.inline("_kinds"))
    pieces = pieces.withColumn("_pieces", F.greatest(F.ceil(F.col("_size") / F.col("_cap")), F.lit(1)))
    pieces = pieces.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).withColumn("_first", F.col("_piece") * F.col("_cap"))
    pieces = pieces.withColumn("_part", F.least(F.col("_cap"), F.col("_size") - F.col("_first")))
    full = pieces.where("_part = _cap").select("_kind", F.concat_ws("-", F.lit("f"), F.col("_key").cast("string"), F.col("_piece").cast("string"), F.col("_turn").cast("string")).alias("container"), "_key", "_piece", "_pieces", "_first", "_part")
    key_kind, kind_kind = rows.schema["_key"].dataType.simpleString(), kinds.schema["_kind"].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_key", "_piece", "_turn"], ascending=False, kind="stable")
        place, _ = pack(pdf["_part"].tolist(), int(pdf["_cap"].iloc[0]))
        shard = int(pdf["_shard"].iloc[0])
        return pdf[["_kind", "_key", "_piece", "_pieces", "_first", "_part"]].assign(container=[f"{shard}-{b}" for b in place])

    schema = f"_kind {kind_kind}, _key {key_kind}, _piece long, _pieces long, _first long, _part long, container string"
    rest = pieces.where("_part < _cap").groupBy("_kind", "_cap", "_shard").applyInPandas(fill, schema)
    done = full.unionByName(rest)
    return done.select(F.col("_kind").alias(kind), "container", F.col("_key").alias(key), F.col("_piece").alias("piece"), F.col("_pieces").alias("pieces"), F.col("_first").alias("first_token"), F.col("_part").alias("tokens"))
