"""Scoring and evaluation: gated rewards, blame, compile@k, group-relative advantages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.values import clamp01


@dataclass(frozen=True)
class Weights:
    compile: float = 1.0
    exec: float = 1.0
    divergence: float = 0.5
    numerical: float = 1.0
    visual: float = 2.0
    perf: float = 0.2


def reward(candidates: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Parts and total; what does not compile scores its compile part alone.

    candidates: compiled, executed, divergence, numerical_error, visual_match, perf_penalty.
    """
    gate = lambda x: F.when(F.col("compiled"), x).otherwise(0.0)
    parts = {
        "r_compile": gate(F.lit(w.compile)),
        "r_exec": gate(F.when(F.col("executed"), w.exec).otherwise(0.0)),
        "r_divergence": gate(w.divergence * (1 - clamp01(F.col("divergence")))),
        "r_numerical": gate(w.numerical * (1 - clamp01(F.col("numerical_error")))),
        "r_visual": gate(w.visual * clamp01(F.col("visual_match"))),
        "r_perf": gate(0.0 - w.perf * clamp01(F.col("perf_penalty"))),
    }
    total = None
    for name in parts:
        total = F.col(name) if total is None else total + F.col(name)
    return candidates.withColumns(parts).withColumn("total", total)


def verdict(total: Column) -> Column:
    return F.when(total >= 3, "runs").when(total >= 1, "compiles").otherwise("broken")


def visual_credit(executed: Column, variance: Column) -> Column:
    return F.when(executed, 1 - F.exp(-32 * variance)).otherwise(0.0)


def worst_site(errors: DataFrame, sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The site of the largest error above 0, the first of equals; errors and sites share idx."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc("err"), "idx") if by else None
    if by:
        top = errors.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    else:
        # without groups a top-1 needs no single-task window
        top = errors.orderBy(F.desc("err"), "idx").limit(1)
    return top.where("err > 0").join(sites, "idx").select(*by, "idx", "site_id", "line", F.col("err").alias("severity"))


def compile_at_k(attempts: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """n, compile@1, compile@k and mean attempts (a failure is charged k) over prompts.

    attempts: (by..., prompt, attempt from 1, ok); only the first k attempts count.
    """
    by = by or []
    own = attempts.where(F.col("attempt") <= k).groupBy(*by, "prompt").agg(F.coalesce(F.bool_or(F.when(F.col("attempt") == 1, F.col("ok"))), F.lit(False)).alias("first"), F.bool_or("ok").alias("any"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("at"))
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("first").cast("double")).alias("compile_at_1"), F.avg(F.col("any").cast("double")).alias("compile_at_k"), F.avg(F.coalesce("at", F.lit(k)).cast("double")).alias("mean_attempts"))


def group_advantage(scored: DataFrame, group: str, value: str) -> DataFrame:
    """(value - mean) / (population deviation + 1e-6) inside each group.

    Means are aggregated before they meet the rows, so a hot group is not one window.
    """
    stats = scored.groupBy(group).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    return scored.join(stats, group).withColumn("advantage", (F.col(value) - F.col("__mean")) / (F.col("__dev") + 1e-6)).drop("__mean", "__dev")


def yield_by_round(attempts: DataFrame) -> DataFrame:
    """(round, newly, verified, pending, yield): newly verified prompts of each round and what remains.

    attempts: (prompt, round from 0, ok).
    """
    firsts = attempts.where("ok").groupBy("prompt").agg(F.min("round").alias("round"))
    rounds = attempts.select("round").distinct()
    newly = rounds.join(firsts.groupBy("round").agg(F.count("*").alias("newly")), "round", "left").select("round", F.coalesce("newly", F.lit(0)).alias("newly"))
    total = attempts.agg(F.countDistinct("prompt").alias("n")).scalar()
    done = F.sum("newly").over(Window.orderBy("round"))  # one row a round
    out = newly.withColumn("verified", done).withColumn("pending", total - F.col("verified"))
    return out.withColumn("yield", F.col("verified") / total)
