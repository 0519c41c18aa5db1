"""Writers: tables, the nested gazetteer, JDBC in batches, and stored locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.resolve import merge_locations


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def create_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64) -> bool:
    """Saves df as a table unless there is one of that name; bucketed and sorted by a key instead of an index."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    writer = df.write
    (writer.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else writer).saveAsTable(name)
    return True


def replace_table(df: DataFrame, name: str) -> None:
    """What a truncate and insert would do."""
    df.write.mode("overwrite").saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 1_000, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch).options(**options).mode("append").save()


def location_documents(best: DataFrame) -> DataFrame:
    """(post_id, locations): each post's places in order of name."""
    fields = [c for c in best.columns if c not in ("post_id", "toponym")]
    return best.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("toponym", *fields))).alias("locations"))


def newest_version(spark: SparkSession, path: str) -> str | None:
    """The newest version below `path` that was written as a whole; None where there is none. Goes by the versions
    themselves, not by the pointer, so that it holds whenever a job is lost."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(root)), reverse=True)
    return next((f"{path}/{n}" for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))), None)


def upsert_locations(spark: SparkSession, path: str, new: DataFrame, version: int) -> str:
    """Merges new locations into the newest older version below `path` and writes the next one; returns its place.
    A version counts once it is whole, so that a lost job leaves the old one; one written again is the same.
    `current` below `path` names the newest for readers."""
    target = f"{path}/v{version:08d}"
    merged = new.select("post_id", "toponym", "geonameid", "avg_score")
    last = newest_version(spark, path)
    if last == target:
        fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(target), True)
        last = newest_version(spark, path)
    if last:
        merged = merge_locations(spark.read.parquet(last), merged)
    merged.write.mode("overwrite").parquet(target)
    spark.createDataFrame([(target,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return target
