"""Trace queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import values as v
from lanewise.operators import trace as tr
from lanewise.plans.registry import query, table

_KEY = "l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax"


def lineitem_trace(spark: SparkSession, sf_dir: str, bits: str, *extra: str) -> DataFrame:
    """site = line number, lane = position in a total order, active = not returned."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as site", "l_returnflag != 'R' as active", bits + " as bits", *extra, *_KEY.split(", "))
    own = [e.rsplit(" as ", 1)[1] for e in extra]
    return tr.numbered(rows, "site", _KEY.split(", "), keep=["bits", "active", *own]).select("site", "lane", "bits", "active", *own)


def all_active(trace: DataFrame) -> DataFrame:
    return trace.withColumn("active", F.lit(True))


def u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_trace(spark, sf_dir, "cast(l_quantity as bigint)")


def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lineitem_trace(spark, sf_dir, "0L", "cast(l_discount as float) as x")
    return t.withColumn("bits", v.float_bits(F.col("x"))).drop("x")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("1 as site", "event_id as lane", "event_type as class", "value > 50 as active", "cast(round(value * 100) as bigint) as bits")


_U32 = f"t AS (SELECT l_linenumber site, row_number() OVER (PARTITION BY l_linenumber ORDER BY {_KEY}) - 1 lane, CAST(l_quantity AS BIGINT) bits, l_returnflag <> 'R' active FROM lineitem)"
_F32 = f"t AS (SELECT l_linenumber site, row_number() OVER (PARTITION BY l_linenumber ORDER BY {_KEY}) - 1 lane, CAST(CAST(CAST(l_discount AS FLOAT) AS BIT)::UINTEGER AS BIGINT) bits, l_returnflag <> 'R' active FROM lineitem)"
_EV = "t AS (SELECT 1 site, event_id lane, event_type class, value > 50 active, CAST(round(value * 100) AS BIGINT) bits FROM events)"
_WIDTH = "CASE WHEN most = 0 THEN 0 ELSE length(bin(most)) END"
_LEB = "greatest(1, CAST(ceil(length(bin(n)) / 7.0) AS BIGINT))"


def _entropy_sql(value: str, by: str, source: str, ctes: str) -> str:
    return f"WITH {ctes}, c AS (SELECT {by}, {value} v, count(*) n FROM {source} GROUP BY ALL) SELECT {by}, round(greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) entropy_bits FROM c GROUP BY {by}"


_RES_U = "r AS (SELECT site, lane // 32 warp, lane, bits, min(bits) OVER (PARTITION BY site, lane // 32) base FROM t WHERE active), e AS (SELECT *, bits - base residual FROM r)"
_RES_F = "r AS (SELECT site, lane // 32 warp, lane, bits, first_value(bits) OVER (PARTITION BY site, lane // 32 ORDER BY lane) base FROM t WHERE active), e AS (SELECT *, xor(bits, base) residual FROM r)"


def _cost_sql(res: str, ctes: str) -> str:
    most = "max(residual)" if res is _RES_U else "bit_or(residual)"
    return f"""WITH {ctes}, {res}, o AS (SELECT site, warp, count(*) n_active, {most} most FROM e GROUP BY ALL),
w AS (SELECT DISTINCT site, lane // 32 warp FROM t),
k0 AS (SELECT w.site, w.warp, coalesce(n_active, 0) n_active, coalesce(most, 0) most FROM w LEFT JOIN o ON w.site = o.site AND w.warp = o.warp),
k AS (SELECT site, warp, n_active, {_WIDTH} width FROM k0),
cost AS (SELECT site, warp, n_active, width, 39 + n_active * width packed_bits, 1 + 32 * n_active raw_bits, least(39 + n_active * width, 1 + 32 * n_active) cost_bits FROM k)"""


def _size_sql(res: str, ctes: str, masked: bool) -> str:
    mask = "CAST(ceil(n / 8.0) AS BIGINT)" if masked else "0"
    return _cost_sql(res, ctes) + f""", n AS (SELECT site, count(*) n, count(*) FILTER (WHERE active) n_active FROM t GROUP BY site),
b AS (SELECT site, sum(cost_bits) bits FROM cost GROUP BY site),
s AS (SELECT n.site, n, n_active, CAST(4 + {_LEB} + {mask} + ceil(bits / 8.0) AS BIGINT) n_bytes FROM n JOIN b ON n.site = b.site)
SELECT site, CAST(n AS BIGINT) n, CAST(n_active AS BIGINT) n_active, n_bytes, round(8.0::DOUBLE * n_bytes / n_active, 6) bits_per_value, round(32 / (8.0::DOUBLE * n_bytes / n_active), 6) ratio FROM s"""


def _sizes(df: DataFrame) -> DataFrame:
    return df.select("site", F.col("n").cast("long"), F.col("n_active").cast("long"), "n_bytes", F.round("bits_per_value", 6).alias("bits_per_value"), F.round("ratio", 6).alias("ratio"))


def _costs(df: DataFrame) -> DataFrame:
    return df.select("site", "warp", F.col("n_active").cast("long"), F.col("width").cast("long"), "packed_bits", "raw_bits", "cost_bits")


_COST_COLUMNS = " SELECT site, warp, CAST(n_active AS BIGINT) n_active, CAST(width AS BIGINT) width, CAST(packed_bits AS BIGINT) packed_bits, CAST(raw_bits AS BIGINT) raw_bits, CAST(cost_bits AS BIGINT) cost_bits FROM cost"
_DIV = "c AS (SELECT lane // 32 warp, class, count(*) n FROM t WHERE {where} GROUP BY ALL), w AS (SELECT warp, max(n) most, sum(n) n_all FROM c GROUP BY warp)"


@query(f"WITH {_EV}, {_DIV.format(where='true')} SELECT round(1 - sum(most) / sum(n_all), 6) divergence, CAST(sum(most) AS BIGINT) majority, CAST(sum(n_all) AS BIGINT) n_active FROM w")
def branch_divergence_events(spark, d):
    return tr.divergence(all_active(events(spark, d))).select(F.round("divergence", 6).alias("divergence"), "majority", "n_active")


@query(f"WITH {_EV}, {_DIV.format(where='active')} SELECT round(1 - sum(most) / sum(n_all), 6) divergence, CAST(sum(most) AS BIGINT) majority, CAST(sum(n_all) AS BIGINT) n_active FROM w")
def masked_divergence_events(spark, d):
    return tr.divergence(events(spark, d)).select(F.round("divergence", 6).alias("divergence"), "majority", "n_active")


@query(f"WITH {_EV}, {_DIV.format(where='true')} SELECT warp, CAST(most AS BIGINT) majority, CAST(n_all AS BIGINT) n_active, round(1 - most / n_all, 6) divergence FROM w")
def warp_divergence_events(spark, d):
    return tr.warp_divergence(all_active(events(spark, d))).select("warp", "majority", "n_active", F.round("divergence", 6).alias("divergence"))


@query(f"WITH {_EV} SELECT site, count(*) n, count(*) FILTER (WHERE active) n_active FROM t GROUP BY site")
def active_count_events(spark, d):
    return events(spark, d).groupBy("site").agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"))


@query(_entropy_sql("bits", "site", "t", _U32))
def order0_entropy_lineitem(spark, d):
    return tr.entropy(u32(spark, d), "bits", ["site"]).select("site", F.round("entropy_bits", 6).alias("entropy_bits"))


@query(f"WITH {_U32}, {_RES_U} SELECT site, warp, lane, base, residual FROM e")
def warp_residuals_u32(spark, d):
    return tr.residuals(u32(spark, d)).select("site", "warp", "lane", "base", "residual")


@query(f"WITH {_F32}, {_RES_F} SELECT site, warp, lane, base, residual FROM e")
def warp_residuals_f32(spark, d):
    return tr.residuals(f32(spark, d), "F32").select("site", "warp", "lane", "base", "residual")


@query(_entropy_sql("residual", "site", "e", f"{_U32}, {_RES_U}"))
def warp_residual_entropy_u32(spark, d):
    return tr.entropy(tr.residuals(u32(spark, d)), "residual", ["site"]).select("site", F.round("entropy_bits", 6).alias("entropy_bits"))


@query(_entropy_sql("residual", "site", "e", f"{_F32}, {_RES_F}"))
def warp_residual_entropy_f32(spark, d):
    return tr.entropy(tr.residuals(f32(spark, d), "F32"), "residual", ["site"]).select("site", F.round("entropy_bits", 6).alias("entropy_bits"))


@query(_cost_sql(_RES_U, _U32) + _COST_COLUMNS)
def warp_cost_u32(spark, d):
    return _costs(tr.warp_costs(u32(spark, d)))


@query(_cost_sql(_RES_F, _F32) + _COST_COLUMNS)
def warp_cost_f32(spark, d):
    return _costs(tr.warp_costs(f32(spark, d), "F32"))


@query(_size_sql(_RES_U, _U32, True))
def codec_bpv_u32(spark, d):
    return _sizes(tr.codec_sizes(u32(spark, d), masked=True))


@query(_size_sql(_RES_F, _F32, True))
def codec_bpv_f32(spark, d):
    return _sizes(tr.codec_sizes(f32(spark, d), "F32", masked=True))


@query(_size_sql(_RES_U, _U32.replace("l_returnflag <> 'R' active", "true active"), False))
def codec_ratio_u32(spark, d):
    return _sizes(tr.codec_sizes(all_active(u32(spark, d))))


@query(_size_sql(_RES_U, _EV, True))
def masked_codec_events(spark, d):
    return _sizes(tr.codec_sizes(events(spark, d), masked=True))


_EMB = "t AS (SELECT vec_id site, unnest(generate_series(0, len(embedding) - 1)) lane, unnest(embedding) x FROM embeddings)"


def embedding_lanes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("site"), F.posexplode("embedding").alias("lane", "x")).withColumn("lane", F.col("lane").cast("long"))


@query(f"WITH {_EMB} SELECT site, lane, CAST(CAST(x AS BIT)::UINTEGER AS BIGINT) bits FROM t")
def float_bits_embed(spark, d):
    return embedding_lanes(spark, d).select("site", "lane", v.float_bits(F.col("x")).alias("bits"))


@query(_size_sql(_RES_F, _EMB.replace("t AS", "t0 AS") + ", t AS (SELECT site, lane, CAST(CAST(x AS BIT)::UINTEGER AS BIGINT) bits, true active FROM t0)", False))
def codec_embed_f32(spark, d):
    t = embedding_lanes(spark, d).select("site", "lane", v.float_bits(F.col("x")).alias("bits"), F.lit(True).alias("active"))
    return _sizes(tr.codec_sizes(t, "F32"))


# strict: products in float; fast: in double, then rounded once
_PAIR = f"""p AS (SELECT l_linenumber site, row_number() OVER (PARTITION BY l_linenumber ORDER BY {_KEY}) - 1 lane,
  CAST(l_extendedprice AS FLOAT) * (CAST(1 AS FLOAT) - CAST(l_discount AS FLOAT)) a, CAST(l_extendedprice * (1 - l_discount) AS FLOAT) b FROM lineitem),
q AS (SELECT *, CAST(CAST(a AS BIT)::UINTEGER AS BIGINT) ab, CAST(CAST(b AS BIT)::UINTEGER AS BIGINT) bb FROM p),
u AS (SELECT site, lane, CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CASE WHEN a = b THEN 0 ELSE abs((CASE WHEN ab >= 2147483648 THEN 4294967295 - ab ELSE ab + 2147483648 END) - (CASE WHEN bb >= 2147483648 THEN 4294967295 - bb ELSE bb + 2147483648 END)) END ulp FROM q),
d AS (SELECT *, abs(a - b) / greatest(abs(a), abs(b), 1e-30) rel FROM u)"""


def strict_and_fast(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = lineitem_trace(spark, d, "0L", "cast(l_extendedprice as float) * (cast(1 as float) - cast(l_discount as float)) as a", "cast(l_extendedprice * (1 - l_discount) as float) as b")
    return tuple(all_active(both).select("site", "lane", "active", v.float_bits(F.col(c)).alias("bits")) for c in "ab")


@query(f"WITH {_PAIR} SELECT site, lane, CAST(ulp AS BIGINT) ulp FROM d WHERE ulp > 0")
def ulp_diff_strict_fast(spark, d):
    a, b = strict_and_fast(spark, d)
    both = a.select("site", "lane", F.col("bits").alias("x")).join(b.select("site", "lane", F.col("bits").alias("y")), ["site", "lane"])
    return both.select("site", "lane", v.ulp_distance(F.col("x"), F.col("y")).alias("ulp")).where("ulp > 0")


@query(f"""WITH {_PAIR} SELECT site, count(*) n, count(*) FILTER (WHERE ulp > 0) mismatches, CAST(max(ulp) AS BIGINT) max_ulp, round(avg(ulp), 6) mean_ulp, round(max(rel), 12) max_rel,
CAST(coalesce(min(CASE WHEN ulp > 0 THEN lane END), -1) AS BIGINT) first_mismatch FROM d GROUP BY site""")
def numdiff_summary(spark, d):
    out = tr.numeric_diff(*strict_and_fast(spark, d), by=["site"])
    return out.select("site", "n", "mismatches", "max_ulp", F.round("mean_ulp", 6).alias("mean_ulp"), F.round("max_rel", 12).alias("max_rel"), "first_mismatch")


@query(f"WITH {_PAIR} SELECT site, lane, round(rel, 12) rel FROM d ORDER BY rel DESC, site, lane LIMIT 50")
def relative_error_top(spark, d):
    rows = lineitem_trace(spark, d, "0L", "cast(l_extendedprice as float) * (cast(1 as float) - cast(l_discount as float)) as a", "cast(l_extendedprice * (1 - l_discount) as float) as b")
    return rows.select("site", "lane", v.relative_error(F.col("a"), F.col("b")).alias("rel")).orderBy(F.desc("rel"), "site", "lane").limit(50).withColumn("rel", F.round("rel", 12))


@query("""SELECT round(exp(-avg((CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)))), 9) similarity, a.vec_id site FROM
(SELECT vec_id, unnest(generate_series(1, len(embedding))) p, unnest(embedding) x FROM embeddings) a JOIN (SELECT vec_id, unnest(generate_series(1, len(embedding))) p, unnest(embedding) y FROM embeddings) b
ON b.vec_id = a.vec_id + 1 AND a.p = b.p GROUP BY a.vec_id""")
def image_similarity_embed(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    square = F.aggregate(F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
    n = F.least(F.size("embedding"), F.size("other"))
    return pairs.select(F.col("vec_id").alias("site"), F.round(F.when(n == 0, 0.0).otherwise(F.exp(-square / n)), 9).alias("similarity"))


@query("""SELECT vec_id site, round(var_pop(0.2126 * CAST(embedding[k] AS DOUBLE) + 0.7152 * CAST(embedding[k + 1] AS DOUBLE) + 0.0722 * CAST(embedding[k + 2] AS DOUBLE)), 9) variance, bool_and(isfinite(embedding[k]) AND isfinite(embedding[k + 1]) AND isfinite(embedding[k + 2])) finite
FROM (SELECT vec_id, embedding, unnest(generate_series(1, 61, 3)) k FROM embeddings) GROUP BY vec_id""")
def finite_luminance_variance(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))).alias("k"))
    r, g, b = (F.get("embedding", F.col("k") + j).cast("double") for j in range(3))
    pixels = rows.select(F.col("vec_id").alias("site"), v.luminance(r, g, b).alias("y"), (v.finite(r) & v.finite(g) & v.finite(b)).alias("ok"))
    return pixels.groupBy("site").agg(F.round(F.var_pop("y"), 9).alias("variance"), F.bool_and("ok").alias("finite"))


_SITES = "s AS (SELECT DISTINCT l_linenumber site, 'Op' || l_linenumber def_op, 10 * l_linenumber line FROM lineitem)"
_LINES = "x AS (SELECT l_orderkey lane, l_linenumber site, CAST(max(l_quantity) AS BIGINT) bits FROM lineitem GROUP BY ALL)"
_STEPS = f"{_SITES}, {_LINES}, st AS (SELECT lane, x.site, def_op, line, bits, row_number() OVER w - 1 step, bits - lag(bits) OVER w delta, lead(x.site) OVER w next_site FROM x JOIN s ON x.site = s.site WHERE bits % 5 <> 0 WINDOW w AS (PARTITION BY lane ORDER BY x.site))"


def order_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("lane"), F.col("l_linenumber").alias("site")).agg(F.max("l_quantity").cast("long").alias("bits"))
    sites = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("site")).distinct().select("site", F.concat(F.lit("Op"), "site").alias("def_op"), (10 * F.col("site")).alias("line"))
    return tr.timeline(rows.withColumn("active", F.col("bits") % 5 != 0), sites)


@query(f"WITH {_STEPS} SELECT lane, site, def_op, line, bits, CAST(step AS INTEGER) step FROM st")
def timeline_order(spark, d):
    return order_steps(spark, d).select("lane", "site", "def_op", "line", "bits", "step")


@query(f"WITH {_STEPS}, m AS (SELECT *, max(step) OVER (PARTITION BY lane) last FROM st) SELECT lane, site, bits, CAST(step AS INTEGER) step FROM m WHERE step = greatest(0, least(2, last))")
def timeline_seek(spark, d):
    return tr.seek(order_steps(spark, d), 2).select("lane", "site", "bits", "step")


@query(f"WITH {_STEPS} SELECT lane, site, delta, next_site FROM st")
def timeline_step_delta(spark, d):
    return order_steps(spark, d).select("lane", "site", "delta", "next_site")


@query(f"WITH {_U32} SELECT lane, CASE WHEN active THEN bits ELSE 0 END bits FROM t WHERE site = 4")
def column_by_site(spark, d):
    return u32(spark, d).where("site = 4").select("lane", F.when(F.col("active"), F.col("bits")).otherwise(0).alias("bits"))


@query(f"WITH {_U32} SELECT site, CAST(sum(bits) AS BIGINT) total, min(lane) first_lane FROM t WHERE active GROUP BY site")
def inactive_lane_skip(spark, d):
    return u32(spark, d).where("active").groupBy("site").agg(F.sum("bits").alias("total"), F.min("lane").alias("first_lane"))


@query("""WITH q AS (SELECT vec_id site, unnest(generate_series(0, 63)) lane, embedding e FROM embeddings)
SELECT site, lane, round(CAST(CASE WHEN lane % 4 < 2 THEN e[lane - lane % 4 + 2] - e[lane - lane % 4 + 1] ELSE e[lane - lane % 4 + 4] - e[lane - lane % 4 + 3] END AS DOUBLE), 6) dpdx,
round(CAST(CASE WHEN lane % 2 = 0 THEN e[lane - lane % 4 + 3] - e[lane - lane % 4 + 1] ELSE e[lane - lane % 4 + 4] - e[lane - lane % 4 + 2] END AS DOUBLE), 6) dpdy FROM q""")
def quad_derivatives_embed(spark, d):
    from lanewise.functions.opcodes import quad_derivatives

    out = quad_derivatives(embedding_lanes(spark, d), value="x", by=("site",))
    return out.select("site", "lane", F.round(F.col("dpdx").cast("double"), 6).alias("dpdx"), F.round(F.col("dpdy").cast("double"), 6).alias("dpdy"))
