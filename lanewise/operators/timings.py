"""Benchmark samples: statistics by name, and the records that a suite writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.trace import numbered


def sample_stats(samples: DataFrame, by: str, value: str = "ns") -> DataFrame:
    """(by, min, median, mean, max, n); the median of an even number is the upper of the middle two.

    Samples are ranked by range pieces, so a name with very many of them is no single task's.
    """
    ranked = numbered(samples.select(by, value).where(F.col(value).isNotNull()), by, [value], "at")
    totals = ranked.groupBy(by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
    middle = ranked.join(totals.select(by, F.floor(F.col("n") / 2).alias("at")), [by, "at"]).select(by, F.col(value).alias("median"))
    return totals.join(middle, by).select(by, "min", "median", "mean", "max", "n")


def records(stats: DataFrame, suite: str, by: str, unit: str = "ns") -> DataFrame:
    """(suite, name, metric, value, unit): a row a statistic."""
    metrics = ("min", "median", "mean", "max")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return stats.select(F.lit(suite).alias("suite"), F.col(by).alias("name"), F.explode(pairs).alias("r")).select("suite", "name", "r.*", F.lit(unit).alias("unit"))


def write_records(rows: DataFrame, path: str) -> None:
    """The records as JSON lines and as CSV with a header."""
    rows.write.json(f"{path}/json")
    rows.write.option("header", True).csv(f"{path}/csv")
