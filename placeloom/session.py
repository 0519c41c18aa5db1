"""Session helpers shared by all operators: table access, guarded broadcasts, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown that it has no more rows than this.
MAX_BROADCAST_ROWS = 300_000
#: Nor more bytes, with texts and nested values counted as JSON.
MAX_BROADCAST_BYTES = 200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows, and those at most max_bytes. Reads no more rows than that."""
    longest = [c for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    text = [F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in longest))))] if longest else []
    size = F.sum(sum(text, F.lit(8 * len(df.columns))).cast("long"))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when its counted rows and bytes allow it; otherwise df, so that the join shuffles.
    df is worked out for the count: cut it first where that is dear."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir.

    Where that is unset, a session on this machine alone gets a temporary folder, deleted when Python ends; on a
    cluster it is an error, because executors couldn't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder all executors share; the master is {master}")
        folder = tempfile.mkdtemp(prefix="placeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends at files that survive executors.

    With `release` a collection on the driver lets Spark delete the shuffle files nothing refers to any more:
    for steps whose shuffles are large beside their input."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files that cut() wrote for df. Only for tables no returned result depends on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, so that no path needs to be set there."""
    sc = spark.sparkContext
    if getattr(sc, "_placeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="placeloom-code-")) / "placeloom_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._placeloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over at least as many tasks as run at once. Only a table of few files is shuffled."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
