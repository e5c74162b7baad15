"""Streams of trace and corpus rows (an extension: the batch operators, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """New files of a Parquet folder as a stream; what was read is in the query's checkpoint, so it resumes."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def first_occurrences(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once they are older than delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, time: str, width: str, delay: str, by: str) -> DataFrame:
    """(by, start, n) of event-time windows; rows later than delay are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "n")


def warp_counts(trace: DataFrame, warp_size: int = 32) -> DataFrame:
    """(site, warp, n_active, most): a warp is a window by count, so running state is one row a warp."""
    warp = F.floor(F.col("lane") / warp_size).cast("long")
    active = trace.where("active")
    return active.groupBy("site", warp.alias("warp")).agg(F.count("*").alias("n_active"), (F.max("bits") - F.min("bits")).alias("most"))


def sessions(events: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """(by, start, end, n) of activity sessions."""
    own = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return own.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
