"""Dates and step times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso_to_time(text: Column) -> Column:
    """The time of an ISO text to the second, without a zone; null where it is none."""
    return F.try_to_timestamp(text, F.lit(ISO)).cast("timestamp_ntz")


def time_to_iso(time: Column) -> Column:
    return F.date_format(time, ISO)


def daterange(spark: SparkSession, start: str, end: str, hours: int, most: int | None = None, include_start: bool = False) -> DataFrame:
    """(step, step_start, step_end): ends every `hours` after start up to end, at most `most` of them; with
    include_start step 0 ends at the start itself."""
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    rows = spark.range(1).select(F.posexplode(F.sequence(first, last, F.expr(f"INTERVAL {int(hours)} HOURS"))).alias("step", "step_end"))
    rows = rows.where(F.col("step") >= (0 if include_start else 1)) if most is None else rows.where((F.col("step") >= (0 if include_start else 1)) & (F.col("step") <= most))
    return rows.select(F.col("step").cast("long").alias("step"), (F.col("step_end") - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("step_start"), "step_end")
