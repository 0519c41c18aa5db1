"""Groups of near-duplicate texts within a time window (problem 2).

Texts of the same words within half the window are one node, so that copies are never paired. A node's
fingerprint has a bit for each of 128 word classes, set when the node has an odd number of words of
the class: it differs in at most as many bits as two nodes differ in words. Similar nodes share one
of their rarest words, so nodes meet in shards by rare word; where many texts have that word, by it and the
next words they share, of which the same bound tells how far they lie back: a shard splits as the data grow.
Within a shard a vantage-point tree over the fingerprints parts them by Hamming distance, and the triangle
inequality prunes the parts that a node's ball doesn't reach; a ball across a boundary asks both sides. Found
pairs are checked exactly, and links joined to groups by alternating star contraction. A node is identified
by a 64-bit hash of its words and time, words by 32-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.vptree import LEAF, hamming, pairs_within
from placeloom.llm.words import word_list
from placeloom.session import broadcast_if_small, cut

CLASSES = 1 << 18  #: word classes whose frequencies are counted
HOT_WORD = 50_000  #: texts a shard aims at; it is split by a second shared word beyond, by a third beyond DEEPER times as many
DEEPER = 64
MET_AT_ONCE = 40_000  #: rows that meet at a time, and with what is kept of the rows before
TOLD_AT_ONCE = 50_000  #: pairs that the trees find before they are told by the exact bounds
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(word_list(text), lambda w: F.hash(F.lower(w)))))


def _mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys with one more word mixed in."""
    x = (key ^ word.astype(np.uint64)) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def class_counts(nodes: DataFrame) -> np.ndarray:
    """Texts that have a word of each class: at most CLASSES numbers, whatever the corpus."""
    rows = nodes.select(F.explode("words").alias("w")).groupBy(F.pmod("w", F.lit(CLASSES)).alias("c")).count()
    got = rows.toPandas()
    counts = np.zeros(CLASSES, np.int64)
    counts[got["c"].to_numpy(int)] = got["count"].to_numpy(int)
    return counts


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity of the words in each of 128 classes, as two words for each list. Lists aren't empty."""
    if len(offsets) < 2:
        return np.zeros((0, 2), np.uint64)
    where = (values.astype(np.int64).astype(np.uint64) * _MIX) >> np.uint64(57)
    bit = np.uint64(1) << (where & np.uint64(63))
    high = where > np.uint64(63)
    none = np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(side, bit, none), offsets[:-1]) for side in (~high, high)], axis=1)


class Threshold:
    """A Jaccard similarity of num / den, and the bounds that follow from it in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Rarest words of which similar texts share one."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most words in which similar texts of a and b words differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def radius(self, n: np.ndarray) -> np.ndarray:
        """The same for a partner of any size."""
        return (self.den - self.num) * n // self.num

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def group_nodes(docs: DataFrame, key: str, time: str, text: str, window_s: int, least_words: int) -> DataFrame:
    """(node, key, at): the node of each text of enough words. Null keys, times and texts are left out."""
    # The words come out of a generator, so that no later use works them out again.
    rows = docs.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.explode(F.array(word_hashes(F.col(text)))).alias("words"))
    rows = rows.where(F.col("key").isNotNull() & F.col("at").isNotNull() & (F.size("words") >= least_words))
    return rows.withColumn("node", F.xxhash64("words", F.floor(F.col("at") / (window_s * 500_000)).cast("long"))).select("node", "key", "at", "words")


def meeting(window_s: int, least: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in order of shard and time to (a, b): nodes of a shard that are near in fingerprint and time.

    A row is compared with the rows before it that its window reaches, and with each of them once."""
    window, few = window_s * 1_000_000, LEAF

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                rows += batch.num_rows
            if rows >= MET_AT_ONCE:
                yield some
                some, rows = [], 0
        if some:
            yield some

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for some in gathered(batches):
            cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in range(6)]
            old = 0
            if kept is not None:
                old = len(kept[0])
                cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
            shard, first, node, low, high, rest = cols
            bits, n, last = np.stack([low, high], axis=1).view(np.uint64), rest >> 40, first + (rest & ((1 << 40) - 1))
            yield from _meet(shard, first, last, node, bits, n, old)
            # What a later row of the same shard can still meet.
            keep = (shard == shard[-1]) & (first >= first[-1] - window - window // 2)
            kept = [c[keep] for c in cols]

    def _meet(shard, first, last, node, bits, n, old) -> Iterator[pa.RecordBatch]:
        def told(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (hamming(bits.take(i, axis=0), bits.take(j, axis=0)) <= least.apart(n[i], n[j])) & ((i >= old) | (j >= old)) & (node[i] != node[j]) & least.sizes(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = (first[i] - last[j] <= window) & (first[j] - last[i] <= window)
            a, b = node[i[ok]], node[j[ok]]
            return np.minimum(a, b), np.maximum(a, b)

        def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

        low = np.ascontiguousarray(bits[:, 0])
        most_apart = np.minimum(least.radius(n), 255).astype(np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        ends = np.append(starts[1:], len(shard))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        # Rows of the same shard that begin before a row's window ends, in whole seconds.
        begin = (first - first.min()) // 1_000_000
        span = int(begin.max()) + window_s * 2
        ahead = np.searchsorted(group * span + begin, group * span + begin + (last - first + window) // 1_000_000 + 1, side="right")
        ahead = np.minimum(ahead, ends[group])
        most = np.maximum.reduceat(ahead - np.arange(len(ahead)), starts)
        i = np.flatnonzero((most <= few)[group])
        reach = ahead[i] - i
        found = []
        for lag in range(1, few):
            live = reach > lag
            i, reach = i[live], reach[live]
            if not len(i):
                break
            # First what is cheap and leaves few pairs, then the exact bounds.
            k = i[np.bitwise_count(low.take(i) ^ low.take(i + lag)) <= most_apart.take(i)]
            found.append(told(k, k + lag))
        # What the trees find is told in large parts, and goes on in large batches.
        near, waiting = [], 0
        for s, e in zip(starts[most > few], ends[most > few]):
            # Slices of one window and a half: a row meets the rows before it as far as its window and the longest node reach back.
            slices = (first[s:e] - first[s]) // (window + window // 2)
            cuts = s + np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [e - s]])
            longest = int((last[s:e] - first[s:e]).max())
            for lo, hi in zip(np.maximum(cuts[:-1], old), cuts[1:]):
                if lo >= hi:
                    continue
                since = s + np.searchsorted(first[s:e], first[lo:hi] - window - longest)
                base = since[0]
                for q, t in pairs_within(bits[base:hi], bits[lo:hi], least.radius(n[lo:hi]), LEAF, since - base, np.arange(lo, hi) - base):
                    near.append((q + lo, t + base))
                    waiting += len(q)
                    if waiting > TOLD_AT_ONCE:
                        found.append(told(*(np.concatenate(x) for x in zip(*near))))
                        near, waiting = [], 0
                        yield rows(found)
                        found = []
        if near:
            found.append(told(*(np.concatenate(x) for x in zip(*near))))
        if found:
            yield rows(found)

    return meet


def candidate_pairs(nodes: DataFrame, counts: np.ndarray, window_s: int, least: Threshold, hot: int = HOT_WORD) -> DataFrame:
    """(a, b) with a < b: pairs of nodes near in fingerprint and time that share a rare word. Pairs may repeat."""
    sc = nodes.sparkSession.sparkContext
    shared = sc.broadcast(counts.astype(np.int64))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            offsets -= offsets[0]
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            count = freq[values % CLASSES]
            order = np.lexsort((values, count, row))
            nth = np.arange(len(row)) - np.repeat(offsets[:-1], n)
            # Similar texts share one of the first `near` words in this order, a second one among the first near + 1
            # or as many words as there are, and a third among the next.
            near = np.repeat(least.prefix(n), n)
            prints = fingerprints(values, offsets)
            i = np.flatnonzero(nth < near)
            word, r = values[order[i]], row[i]
            deep = (count[order[i]] > hot).astype(np.int64) + (count[order[i]] > hot * DEEPER)
            shard = _mixed(np.zeros(len(i), np.uint64), word)
            whole = [(shard[deep == 0], r[deep == 0])]
            for step in (1, 2):
                more = deep >= step
                i, shard, deep = i[more], shard[more], deep[more]
                # The words after the last one taken, as far as the next shared one may lie back.
                end = np.minimum(np.repeat(offsets[:-1], n) + near + step, np.repeat(offsets[1:], n))[i]
                many = np.maximum(end - i - 1, 0)
                back = np.repeat(np.arange(len(i)), many)
                j = i[back] + 1 + np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
                i, shard, deep = j, _mixed(shard[back], values[order[j]]), deep[back]
                whole.append((shard[deep == step], row[i[deep == step]]))
            shard, r = (np.concatenate(x) for x in zip(*whole))
            first, last = batch.column("first").to_numpy(), batch.column("last").to_numpy()
            cols = [shard.view(np.int64), first[r], batch.column("node").to_numpy()[r], prints[r, 0].view(np.int64), prints[r, 1].view(np.int64), (n[r] << 40) | (last[r] - first[r])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "first", "node", "low", "high", "rest"])

    spreaded = nodes.select("node", "words", "first", "last").mapInArrow(spread, "shard long, first long, node long, low long, high long, rest long")
    return spreaded.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(meeting(window_s, least), "a long, b long")


def similar(a: Column, b: Column, least: Threshold) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * least.den >= (F.size(a) + F.size(b) - both) * least.num


def forest(links: DataFrame) -> DataFrame:
    """As few of each partition's links (a, b) as join the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            out = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b): root is the least node joined to it by links.

    Alternating large and small stars; each round ends in a table in the shared folder. Minima are
    partial aggregates and neighbours are joined, so no node's neighbours are ever gathered.
    """
    edges = cut(forest(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), release=True)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), release=True)
        # Stars whose centres are no leaves are the end: then every a has one b, and no b is an a.
        deep = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        twice = new.groupBy("a").count().where("count > 1").limit(1).count()
        edges = new
        if not deep and not twice:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str, time: str, text: str, num: int = 7, den: int = 10, window_s: int = 86_400, least_words: int = 6, hot: int = HOT_WORD) -> DataFrame:
    """(group_id, key): every text in a group of two or more; group_id is the least key of the group.

    Texts are alike when both have at least least_words words, their times are at most window_s
    seconds apart and the words they share are at least num / den of the words either has; groups
    are chains of alike texts. Rows of the same key are one text. Null keys, times and texts are in
    no group; other columns are ignored.
    """
    least = Threshold(num, den)
    # Written once with their words; every later step reads only the columns it needs.
    rows = cut(group_nodes(docs, key, time, text, window_s, least_words))
    counts = class_counts(rows)
    nodes = rows.groupBy("node").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("words").alias("words"))
    found = cut(candidate_pairs(nodes, counts, window_s, least, hot).distinct(), release=True)
    ends = broadcast_if_small(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    told = rows.select("node", "words").join(ends, "node", "left_semi").dropDuplicates(["node"])
    checked = found.join(told.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(told.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    roots = components(checked.where(similar(F.col("wa"), F.col("wb"), least)).select("a", "b"))
    placed = rows.select("node", "key").join(broadcast_if_small(roots), "node", "left").select(F.coalesce("root", "node").alias("root"), "key")
    placed = cut(placed.distinct(), release=True)
    groups = placed.groupBy("root").agg(F.min("key").alias("group_id"), F.max("key").alias("_last")).where("group_id <> _last").drop("_last")
    return placed.join(broadcast_if_small(groups), "root").select("group_id", F.col("key").alias(key))
