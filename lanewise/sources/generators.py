"""Synthetic trace columns from a 64-bit linear congruential generator.

The generator is sequential, but any position can be reached by squaring its affine step, so each
task starts at its own first lane and the columns are made in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.values import float_bits

MUL, ADD, MASK = 6364136223846793005, 1442695040888963407, (1 << 64) - 1
DEFAULT_SEED = 0x9E3779B97F4A7C15


def jump(state: int, steps: int) -> int:
    """The generator's state after so many steps."""
    mul, add, m, a = 1, 0, MUL, ADD
    while steps:
        if steps & 1:
            mul, add = mul * m & MASK, (add * m + a) & MASK
        m, a = m * m & MASK, (a * m + a) & MASK
        steps >>= 1
    return (mul * state + add) & MASK


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count - 1 as unsigned 32-bit integers in 64 bits."""
    state = np.empty(count, np.uint64)
    if count:
        state[0] = jump(seed or DEFAULT_SEED, first + 1)
        done = 1
        with np.errstate(over="ignore"):
            while done < count:  # doubling: the next block is the last one, so many steps on
                take = min(done, count - done)
                mul, add = (jump(1, done) - jump(0, done)) & MASK, jump(0, done)
                state[done : done + take] = state[:take] * np.uint64(mul) + np.uint64(add)
                done += take
    return state >> np.uint64(32)


def random_column(spark: SparkSession, n: int, seed: int, name: str = "u") -> DataFrame:
    """(lane, u) for lanes 0 .. n - 1."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = batch.column(0).to_numpy()
            if len(lanes):
                yield pa.RecordBatch.from_arrays([pa.array(lanes), pa.array(draws(seed, int(lanes[0]), len(lanes)).astype(np.int64))], ["lane", name])

    return spark.range(n).mapInArrow(fill, f"lane long, {name} long")


def _column(df: DataFrame, bits, site: int = 0) -> DataFrame:
    return df.select(F.lit(site).alias("site"), "lane", bits.cast("long").alias("bits"), F.lit(True).alias("active"))


def constant(spark: SparkSession, n: int, value: int) -> DataFrame:
    return _column(spark.range(n).withColumnRenamed("id", "lane"), F.lit(value))


def random32(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    return _column(random_column(spark, n, seed), F.col("u"))


def warp_gradient(spark: SparkSession, n: int, warp: int = 32, lane_step: int = 1, warp_step: int = 3, noise: int = 2, seed: int = 7) -> DataFrame:
    df = random_column(spark, n, seed)
    noisy = F.col("u") % (noise + 1) if noise else F.lit(0)
    return _column(df, F.pmod(1000 + F.floor(F.col("lane") / warp) * warp_step + F.col("lane") % warp * lane_step + noisy, F.lit(1 << 32)))


def quad_coherent(spark: SparkSession, n: int, seed: int = 11) -> DataFrame:
    quads = random_column(spark, (n + 3) // 4, seed).withColumnRenamed("lane", "quad")
    lanes = quads.select("u", F.explode(F.sequence(4 * F.col("quad"), 4 * F.col("quad") + 3)).alias("lane")).where(F.col("lane") < n)
    return _column(lanes, 500 + F.col("u") % 64)


def float_smooth(spark: SparkSession, n: int, frequency: float = 0.01, amplitude: float = 8.0) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "lane")
    return _column(df, float_bits(amplitude * F.sin(frequency * F.col("lane")) + amplitude))


def with_divergence(column: DataFrame, probability: float, seed: int = 99) -> DataFrame:
    """column with lanes active where a 24-bit uniform draw is below the probability."""
    n = column.count()
    draw = random_column(column.sparkSession, n, seed)
    unit = F.floor(F.col("u") / 256) / float(1 << 24)
    return column.drop("active").join(draw, "lane").select("site", "lane", "bits", (unit < probability).alias("active"))
