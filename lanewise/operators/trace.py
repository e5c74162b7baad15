"""Trace analytics over a long table: (site, lane, bits in [0, 2^32), active).

A warp is warp_size consecutive lanes of a site. One exchange on (site, warp) serves base, residual, cost and
divergence; a site's figures are then sums over its warps, so a hot site is spread over its warps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import values as v
from lanewise.operators.rounds import durable

WARP = 32
#: Warps of a site that are made from one row.
WARPS = 4096
#: Rows of a piece that one task sorts, and rows below which no task is worth its start.
PIECE, FEW = 250_000, 10_000


def with_warp(trace: DataFrame, warp_size: int = WARP) -> DataFrame:
    """Warp size 0 means 1."""
    return trace.withColumn("warp", F.floor(F.col("lane") / max(1, warp_size)).cast("long"))


def numbered(rows: DataFrame, by: str | None, order: list[str], name: str = "lane", keep: list[str] | None = None) -> DataFrame:
    """rows with their number from 0 in each group of ``by`` (None: among all), in order; of their columns, ``by`` and ``keep`` (None: all) stay.

    Rows are range-partitioned by (by, order) into pieces whose number grows with the rows, sorted and numbered inside the
    pieces, and shifted by the rows of their group in earlier pieces: many tasks number a group, each holds about a piece.
    """
    keys = [*([by] if by else []), *order]
    n, most = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(max(n // PIECE + 1, min(most, n // FEW + 1)), *keys).sortWithinPartitions(*keys)
    kept = rows.columns if keep is None else [*([by] if by and by not in keep else []), *keep]
    # the partition's number above 33 bits of the row's place in it
    pieces = durable(sorted_.select(*kept, F.monotonically_increasing_id().alias("__at")))
    group = [by] if by else []
    counts = pieces.groupBy(*group, F.shiftright("__at", 33).alias("__piece")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # a row a group and piece
    earlier = F.sum("__n").over(Window.partitionBy(*group).orderBy("__piece")) - F.col("__n")
    shift = durable(counts.select(*group, "__piece", (earlier - F.col("__first")).alias("__shift")))
    if shift.count() <= FEW:
        shift = F.broadcast(shift)
    placed = pieces.withColumn("__piece", F.shiftright("__at", 33)).join(shift, [*group, "__piece"])
    return placed.select(*[c for c in kept if c != name], (F.col("__at") + F.col("__shift")).alias(name))


def entropy(rows: DataFrame, value: str, by: list[str], name: str = "entropy_bits") -> DataFrame:
    """Order-0 entropy in bits of value's histogram, by group; what is counted is up to the caller."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    # sum(n log n) is as good as sum(p log p) and needs no second pass for the total
    total, nlogn = F.sum("__n"), F.sum(F.col("__n") * F.log2("__n"))
    return counts.groupBy(*by).agg(F.greatest(F.lit(0.0), F.log2(total) - nlogn / total).alias(name))


def residuals(trace: DataFrame, kind: str = "U32", warp_size: int = WARP) -> DataFrame:
    """Active lanes with their warp's base and residual: v - min (U32) or v XOR first (F32)."""
    warps = Window.partitionBy("site", "warp")
    active = with_warp(trace, warp_size).where("active")
    base = F.min("bits").over(warps) if kind == "U32" else F.first("bits").over(warps.orderBy("lane").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    residual = F.col("bits") - F.col("base") if kind == "U32" else F.col("bits").bitwiseXOR(F.col("base"))
    return active.withColumn("base", base).withColumn("residual", residual)


def warp_costs(trace: DataFrame, kind: str = "U32", warp_size: int = WARP) -> DataFrame:
    """(site, warp, n_active, width, packed_bits, raw_bits, cost_bits): raw only if strictly cheaper."""
    warped = with_warp(trace, warp_size)
    if kind == "U32":
        own = warped.where("active").groupBy("site", "warp").agg(F.count("*").alias("n_active"), (F.max("bits") - F.min("bits")).alias("most"))
    else:
        own = residuals(trace, kind, warp_size).groupBy("site", "warp").agg(F.count("*").alias("n_active"), F.bit_or("residual").alias("most"))
    # warps without an active lane still take their packed header, so do those without any row before a site's last one
    last = warped.groupBy("site").agg(F.max("warp").alias("last")).withColumn("last", F.col("last").cast("long"))
    blocks = last.select("site", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / WARPS))).alias("block"))
    spread = blocks.repartition("site", "block")  # a site's warps are made in many tasks, WARPS of them at a time
    every = spread.select("site", F.explode(F.sequence(F.col("block") * WARPS, F.least("last", F.col("block") * WARPS + (WARPS - 1)))).alias("warp"))
    cost = every.join(own, ["site", "warp"], "left").select("site", "warp", F.coalesce("n_active", F.lit(0)).alias("n_active"), v.bit_width(F.coalesce("most", F.lit(0))).alias("width"))
    packed, raw = 39 + F.col("n_active") * F.col("width"), 1 + 32 * F.col("n_active")
    return cost.withColumns({"packed_bits": packed.cast("long"), "raw_bits": raw.cast("long")}).withColumn("cost_bits", F.least("packed_bits", "raw_bits"))


def codec_sizes(trace: DataFrame, kind: str = "U32", warp_size: int = WARP, masked: bool = False) -> DataFrame:
    """(site, n, n_active, n_bytes, bits_per_value, ratio) of each site's encoded column."""
    totals = trace.groupBy("site").agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"))
    bits = warp_costs(trace, kind, warp_size).groupBy("site").agg(F.sum("cost_bits").alias("bits"))
    header = 3 + v.leb128_bytes(F.lit(warp_size)) + v.leb128_bytes(F.col("n"))
    mask = F.ceil(F.col("n") / 8) if masked else F.lit(0)
    size = (header + mask + F.ceil(F.col("bits") / 8)).cast("long")
    out = totals.join(bits, "site").withColumn("n_bytes", size)
    per = F.when(F.col("n_active") > 0, 8.0 * F.col("n_bytes") / F.col("n_active")).otherwise(0.0)
    return out.withColumn("bits_per_value", per).withColumn("ratio", F.when(F.col("bits_per_value") > 0, 32 / F.col("bits_per_value")).otherwise(0.0)).drop("bits")


def divergence(classes: DataFrame, by: list[str] | None = None, warp_size: int = WARP) -> DataFrame:
    """Active-weighted mean of 1 - majority/active over warps; classes: (lane, class, active, by...)."""
    by = by or []
    counts = with_warp(classes, warp_size).where("active").groupBy(*by, "warp", "class").agg(F.count("*").alias("n"))
    warps = counts.groupBy(*by, "warp").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return warps.groupBy(*by).agg(F.when(F.sum("all") > 0, 1 - F.sum("most") / F.sum("all")).otherwise(0.0).alias("divergence"), F.coalesce(F.sum("most"), F.lit(0)).alias("majority"), F.coalesce(F.sum("all"), F.lit(0)).alias("n_active"))


def warp_divergence(classes: DataFrame, by: list[str] | None = None, warp_size: int = WARP) -> DataFrame:
    by = by or []
    counts = with_warp(classes, warp_size).where("active").groupBy(*by, "warp", "class").agg(F.count("*").alias("n"))
    return counts.groupBy(*by, "warp").agg(F.max("n").alias("majority"), F.sum("n").alias("n_active"), (1 - F.max("n") / F.sum("n")).alias("divergence"))


def numeric_diff(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mismatches, max and mean ULP, largest relative error, first mismatching lane (-1: none).

    left and right: (by..., lane, bits, active) of F32 columns; lanes active on both sides count.
    """
    by = by or []
    a = left.where("active").select(*by, "lane", F.col("bits").alias("a"))
    b = right.where("active").select(*by, "lane", F.col("bits").alias("b"))
    both = a.join(b, [*by, "lane"]).withColumn("ulp", v.ulp_distance(F.col("a"), F.col("b")))
    both = both.withColumn("rel", v.relative_error(v.bits_float(F.col("a")), v.bits_float(F.col("b"))))
    off = F.col("ulp") > 0
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(off).alias("mismatches"),
        F.coalesce(F.max("ulp"), F.lit(0)).alias("max_ulp"),
        F.coalesce(F.avg("ulp"), F.lit(0.0)).alias("mean_ulp"),
        F.coalesce(F.max("rel"), F.lit(0.0)).alias("max_rel"),
        F.coalesce(F.min(F.when(off, F.col("lane"))), F.lit(-1)).cast("long").alias("first_mismatch"),
    )


def timeline(trace: DataFrame, sites: DataFrame) -> DataFrame:
    """Steps of each lane by ascending site: position from 0, value and change; inactive lanes have none.

    sites: (site, def_op, line): a dimension; the planner broadcasts it when it is small.
    """
    steps = trace.where("active").join(sites, "site")
    order = Window.partitionBy("lane").orderBy("site")
    return steps.select("lane", "site", "def_op", "line", "bits", (F.row_number().over(order) - 1).alias("step"), (F.col("bits") - F.lag("bits").over(order)).alias("delta"), F.lead("site").over(order).alias("next_site"))


def seek(steps: DataFrame, cursor: int) -> DataFrame:
    """The step at the cursor, clamped to each lane's history."""
    last = F.max("step").over(Window.partitionBy("lane"))
    return steps.withColumn("last", last).where(F.col("step") == F.greatest(F.lit(0), F.least(F.lit(cursor), F.col("last")))).drop("last")
