"""The engine on a stream: each micro-batch's posts are analysed once, windows resolved as their steps close."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeloom.config import DEFAULT, Settings
from placeloom.operators import resolve as rs
from placeloom.sources.sinks import upsert_locations

SPIN_UP, SHIFT = -1, 1  #: the batch number of the warm state; numbers of progress files start at 0


class StreamingEngine:
    """Scores posts as they come and resolves every step that the batch has passed.

    score(posts) gives scored candidates, as scoring.score_candidates does; they are appended under
    `state`, partitioned by day, so that a window reads the days it needs and old days can be dropped.
    A step is resolved when a post from after its end has come; later posts of a closed step are kept
    out of it, as the reading by event time does. `commit` gets each step's best locations; by default
    they are merged into the table under `store`. A batch that is run again writes the same places.
    What has been closed is kept under `state` for each batch, so that an engine started anew goes on where
    the last whole batch ended. `adapt` brings posts of another form to the engine's columns first.
    """

    def __init__(self, score: Callable[[DataFrame], DataFrame], start: datetime, state: str, store: str, settings: Settings = DEFAULT, texts: Callable[[], DataFrame] | None = None, commit: Callable[[DataFrame, int], None] | None = None, adapt: Callable[[DataFrame], DataFrame] | None = None):
        self.score, self.start, self.state, self.store, self.settings, self.texts, self.commit, self.adapt = score, start, state, store, settings, texts, commit, adapt
        self.closed = 0
        self.latest: datetime | None = None

    def step_end(self, step: int) -> datetime:
        return self.start + timedelta(hours=self.settings.slide_h * step)

    def resume(self, spark: SparkSession, batch: int) -> None:
        """Takes up what the batches before this one had closed and seen."""
        folder = f"{self.state}/_progress"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in done if n < batch + SHIFT and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        if done:
            self.closed, self.latest = spark.read.schema("closed int, latest timestamp_ntz").parquet(f"{folder}/{max(done)}").first()

    def _record(self, spark: SparkSession, batch: int) -> None:
        spark.createDataFrame([(self.closed, self.latest)], "closed int, latest timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/_progress/{batch + SHIFT}")

    def _store_scores(self, posts: DataFrame, batch: int) -> None:
        self.score(posts).withColumn("day", F.to_date("posted_at")).write.mode("overwrite").partitionBy("day").parquet(f"{self.state}/batch={batch}")

    def spin_up(self, posts: DataFrame) -> None:
        """Warms the state with the posts of the window before the start: they count in the first windows, but
        no step of their own is resolved."""
        posts = self.adapt(posts) if self.adapt else posts
        since = self.start - timedelta(hours=self.settings.window_h)
        before = F.col("posted_at").between(F.lit(since).cast("timestamp_ntz"), F.lit(self.start).cast("timestamp_ntz"))
        self._store_scores(posts.dropDuplicates(["post_id"]).where(before), SPIN_UP)

    def take(self, posts: DataFrame, batch: int) -> None:
        """One micro-batch: for foreachBatch."""
        spark = posts.sparkSession
        self.resume(spark, batch)
        posts = self.adapt(posts) if self.adapt else posts
        posts = posts.dropDuplicates(["post_id"]).where(F.col("posted_at") > F.lit(self.step_end(self.closed) - timedelta(hours=self.settings.window_h)).cast("timestamp_ntz"))
        self._store_scores(posts, batch)
        newest = posts.agg(F.max("posted_at")).first()[0]
        if newest is not None:
            self.latest = max(newest, self.latest or newest)
            while self.step_end(self.closed + 1) < self.latest:
                self.close(spark, self.closed + 1)
                self.closed += 1
        self._record(spark, batch)

    def close(self, spark, step: int) -> None:
        """Resolves one step from the state's days of its window."""
        end = self.step_end(step)
        since = end - timedelta(hours=self.settings.window_h)
        rows = spark.read.parquet(self.state).where(F.col("day").between(F.lit(since.date()), F.lit(end.date()))).drop("day", "batch").dropDuplicates(["post_id", "toponym", "geonameid"])
        stepped = rs.in_steps(rows, self.start.strftime("%Y-%m-%d %H:%M:%S"), step, step, self.settings)
        averaged = rs.average_scores(stepped, self.texts() if self.texts else None, self.settings)
        best = rs.best_locations(rs.placed_posts(stepped, rs.elect(averaged, self.settings)))
        if self.commit:
            self.commit(best, step)
        else:
            upsert_locations(spark, self.store, best, step)

    def drop_before(self, spark, day) -> None:
        """Deletes days of the state that no open window can need."""
        for path in {f.rsplit("/", 1)[0] for f in spark.read.parquet(self.state).where(F.col("day") < F.lit(day)).inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if f"day={day}" > path.rsplit("/", 1)[1]:
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def run(self, posts: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Starts on a stream of posts: all that is there, or (with `every`) on and on."""
        writer = posts.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(posts: DataFrame, settings: Settings = DEFAULT, late: str = "6 hours") -> DataFrame:
    """Posts by language in sliding windows, with a watermark: late posts beyond it are dropped."""
    timed = posts.withColumn("at", F.col("posted_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{settings.window_h} hours", f"{settings.slide_h} hours"), "lang").agg(F.count("*").alias("posts"))
