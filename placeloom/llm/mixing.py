"""Mixing sources to target weights by systematic sampling (problem 7).

Each source's expected copies per document follow from its target share of the total size. The
prefix sum of the expected copies over the documents of a source, shifted by one random offset,
crosses integers: a document is emitted once for each boundary crossed in its stretch. Documents
are ordered by size, so that the sample's size mix is that of the source; what a source gives is then off its
target by no more than its largest documents weigh. Of OFFSETS random offsets of a source the one that comes
nearest to the target is taken. The prefix sum is taken in two levels, over buckets and within them, so that
no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small, cut

BUCKET_ROWS = 50_000  #: documents of one source and size that a bucket aims at
OFFSETS = 32  #: random offsets tried for each source of a recipe
OFFSET_SEED = 20_160_104


def mix_sources(sized: DataFrame, targets: DataFrame, key: str, source: str, size: str, recipe: str, share: str, max_repeats: str, total: int | None = None, seed: int = OFFSET_SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: (recipe, source, key, tokens, copies) for every document used at all;
    report: (recipe, source, target_share, actual_share, target_tokens, tokens, documents, copies, most_copies, max_repeats,
    largest): largest is the size of the source's largest document, what tokens may be off by.

    The total size of a recipe is `total`, else the largest at which every source can give its share
    with no document used more than max_repeats times. With a larger `total` a short source gives
    what its cap allows and the report shows the lower share. Shares are relative to their sum in
    the recipe. Null and zero shares, sources without documents or of size 0 give no rows in the mix;
    null sizes count as 0; documents of null source are never used; repeated keys count one by one.
    """
    docs = sized.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).where("_source is not null")
    goal = targets.select(F.col(recipe).alias("_recipe"), F.col(source).alias("_source"), F.col(share).cast("double").alias("_share"), F.col(max_repeats).cast("int").alias("_most")).where("_share > 0 and _most > 0")
    goal = goal.withColumn("_share", F.col("_share") / F.sum("_share").over(Window.partitionBy("_recipe")))
    held = docs.groupBy("_source").agg(F.sum("_size").alias("_held"), F.max("_size").alias("_largest"))
    plan = goal.join(held, "_source", "left").withColumn("_room", F.coalesce("_held", F.lit(0)) * F.col("_most"))
    most = F.min(F.when(F.col("_room") > 0, F.col("_room") / F.col("_share"))).over(Window.partitionBy("_recipe"))
    plan = plan.withColumn("_total", F.lit(float(total)) if total else most)
    plan = plan.withColumn("_each", F.least(F.col("_share") * F.col("_total") / F.col("_held"), F.col("_most").cast("double")))
    # Rank within the source in order of (size band, size, salt, key): offsets of buckets, then ranks in them.
    docs = docs.withColumn("_band", F.floor(F.log2(F.col("_size") + 1) * 16).cast("int"))
    bands = docs.groupBy("_source", "_band").agg(F.expr(f"(count(*) - 1) div {BUCKET_ROWS} + 1").alias("_salts"))
    docs = docs.join(broadcast_if_small(bands), ["_source", "_band"]).withColumn("_salt", F.expr(f"pmod(xxhash64(_key, {seed}L), _salts)").cast("int")).drop("_salts")
    buckets = docs.groupBy("_source", "_band", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("_source").orderBy("_band", "_salt").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select("_source", "_band", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = docs.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_band", "_salt").orderBy("_size", "_key")))
    ranked = ranked.join(broadcast_if_small(buckets), ["_source", "_band", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank"))
    ranked = cut(ranked.select("_key", "_source", "_size", "_rank"))

    def copies(offset: Column) -> Column:
        at = F.col("_each") * F.col("_rank") + offset
        return F.least(F.floor(at) - F.floor(at - F.col("_each")), F.col("_most").cast("long"))

    used = ranked.join(broadcast_if_small(plan.where("_held > 0").select("_recipe", "_source", "_each", "_most", (F.col("_each") * F.col("_held")).alias("_aim"))), "_source")
    offsets = [F.pmod(F.xxhash64("_recipe", "_source", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / (1 << 40) for k in range(OFFSETS)]
    tried = used.groupBy("_recipe", "_source").agg(*(F.sum(F.col("_size") * copies(o)).alias(f"_got{k}") for k, o in enumerate(offsets)), F.first("_aim").alias("_aim"))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_got{k}") - F.col("_aim")).alias("off"), F.lit(k).alias("k"), o.alias("offset")) for k, o in enumerate(offsets))))
    chosen = tried.select("_recipe", "_source", best["offset"].alias("_offset"))
    used = used.join(broadcast_if_small(cut(chosen)), ["_recipe", "_source"])
    mix = used.withColumn("_copies", copies(F.col("_offset"))).where("_copies > 0").select("_recipe", "_source", "_key", "_size", "_copies")

    got = mix.groupBy("_recipe", "_source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_tokens"), F.count("*").alias("_documents"), F.sum("_copies").alias("_copies"), F.max("_copies").alias("_top"))
    report = plan.join(got, ["_recipe", "_source"], "left").na.fill(0, ["_tokens", "_documents", "_copies"])
    actual = F.col("_tokens") / F.nullif(F.sum("_tokens").over(Window.partitionBy("_recipe")), F.lit(0))
    report = report.select(F.col("_recipe").alias(recipe), F.col("_source").alias(source), F.col("_share").alias("target_share"), actual.alias("actual_share"), (F.col("_share") * F.col("_total")).alias("target_tokens"), F.col("_tokens").alias("tokens"), F.col("_documents").alias("documents"), F.col("_copies").alias("copies"), F.col("_top").alias("most_copies"), F.col("_most").alias("max_repeats"), F.col("_largest").alias("largest"))
    mix = mix.select(F.col("_recipe").alias(recipe), F.col("_source").alias(source), F.col("_key").alias(key), F.col("_size").alias("tokens"), F.col("_copies").alias("copies"))
    return mix, report
