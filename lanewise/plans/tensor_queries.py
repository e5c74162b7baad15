"""Tensor queries over the embeddings: gathers, gradients, heads, number formats, cross-entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import values as v
from lanewise.operators import numeric
from lanewise.plans.registry import query, table

_LANES = "x AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) j, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings)"


def lanes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("j", "v")).select("vec_id", "label", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


@query("SELECT a.vec_id i, round(list_sum(list_transform(b.embedding, lambda y: CAST(y AS DOUBLE))), 6) total FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7) % (SELECT count(*) FROM embeddings)")
def embedding_gather(spark, d):
    rows = table(spark, d, "embeddings")
    ids = rows.select(F.col("vec_id").alias("i"), ((F.col("vec_id") * 7) % rows.groupBy().count().scalar()).alias("id"))
    out = numeric.gathered(ids, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("row")))
    return out.select("i", F.round(F.aggregate("row", F.lit(0.0), lambda acc, y: acc + y.cast("double")), 6).alias("total"))


@query(f"WITH {_LANES} SELECT label id, j, round(sum(v), 6) v FROM x GROUP BY ALL")
def embedding_scatter_add(spark, d):
    rows = lanes(spark, d)
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("id"))
    return numeric.scatter_added(ids, rows.select(F.col("vec_id").alias("i"), "j", "v")).select("id", "j", F.round("v", 6).alias("v"))


_HEADS = f"{_LANES}, h AS (SELECT vec_id // 8 b, vec_id % 8 h, 0 s, j d, v FROM x)"


def heads(spark, d):
    return lanes(spark, d).select(F.floor(F.col("vec_id") / 8).alias("b"), (F.col("vec_id") % 8).alias("h"), F.lit(0).alias("s"), F.col("j").alias("d"), "v")


@query(f"WITH {_HEADS} SELECT b, 3 * h + g h, s, d, v FROM h, (SELECT unnest([0, 1, 2]) g)")
def heads_repeat(spark, d):
    return numeric.heads_repeated(heads(spark, d), 3).select("b", F.col("h").cast("long").alias("h"), "s", "d", "v")


@query(f"WITH {_HEADS} SELECT b, h // 4 h, s, d, round(sum(v), 6) v FROM h GROUP BY ALL")
def heads_reduce(spark, d):
    return numeric.heads_reduced(heads(spark, d), 4).select("b", "h", "s", "d", F.round("v", 6).alias("v"))


@query("""WITH c AS (SELECT unnest(generate_series(0, 255)) code), p AS (SELECT code, code >> 7 s, (code >> 3) & 15 e, code & 7 m FROM c)
SELECT code, CASE WHEN e = 15 AND m = 7 THEN NULL ELSE (CASE WHEN s = 1 THEN -0.5 ELSE 0.5 END)::DOUBLE * CASE WHEN e = 0 THEN m / 512.0 ELSE (1 + m / 8.0) * pow(2.0, e - 7) END END "value" FROM p""")
def fp8_values(spark, d):
    x = numeric.dequantise_fp8(F.col("id").cast("int"), 0.5)
    return spark.range(256).select(F.col("id").alias("code"), F.when(~F.isnan(x), x).alias("value"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 256) AS INTEGER) & 255) p FROM embeddings), n AS (SELECT vec_id, p, unnest(generate_series(0, 2 * len(p) - 1)) k FROM q),
w AS (SELECT vec_id, k, CASE WHEN k % 2 = 0 THEN p[k // 2 + 1] & 15 ELSE p[k // 2 + 1] >> 4 END x FROM n)
SELECT vec_id, CAST(sum(CASE WHEN x > 7 THEN x - 16 ELSE x END * (1 + k // 32)) AS BIGINT) total FROM w GROUP BY vec_id""")
def int4_group_dequantise(spark, d):
    packed = F.transform("embedding", lambda y: F.floor(y.cast("double") * 256).cast("int").bitwiseAND(255))
    scales = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: k.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", numeric.dequantise_int4_groups(packed, scales, 32).alias("x"))
    return rows.select("vec_id", F.aggregate("x", F.lit(0.0), lambda acc, y: acc + y).cast("long").alias("total"))


_RMS = f"""{_LANES}, z AS (SELECT vec_id, j, v, (1 + (j % 3)) * (v + 0.5) wg, count(*) OVER w n, 1 / sqrt(avg(v * v) OVER w + 1e-6) r FROM x WINDOW w AS (PARTITION BY vec_id))"""


@query(f"WITH {_RMS} SELECT vec_id, j, round(r * wg - v * r * r * r / n * sum(v * wg) OVER (PARTITION BY vec_id), 6) g FROM z")
def rmsnorm_gradient_embed(spark, d):
    weight = F.transform("embedding", lambda y, k: (1 + k % 3).cast("double"))
    grad = F.transform("embedding", lambda y: y.cast("double") + 0.5)
    # columns of their own: a lambda would make them again for each lane
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", weight.alias("w"), grad.alias("g"))
    out = rows.select("vec_id", F.posexplode(numeric.rms_norm_gradient(F.col("embedding"), F.col("w"), F.col("g"))).alias("j", "x"))
    return out.select("vec_id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("g"))


@query(f"WITH {_RMS} SELECT j, round(sum(v * r * (v + 0.5)), 6) g FROM z GROUP BY j")
def rmsnorm_weight_gradient(spark, d):
    rows = table(spark, d, "embeddings").withColumn("g", F.transform("embedding", lambda y: y.cast("double") + 0.5))
    return numeric.rms_norm_weight_gradient(rows, "embedding", "g").select(F.col("j").cast("long").alias("j"), F.round("v", 6).alias("g"))


@query(f"""WITH {_LANES}, l AS (SELECT vec_id, any_value(label) label, ln(sum(exp(v))) z FROM x GROUP BY vec_id)
SELECT round(avg(z - v), 6) loss, count(*) n FROM l JOIN x ON l.vec_id = x.vec_id AND x.j = l.label WHERE l.label <> 3""")
def xent_with_ignored_label(spark, d):
    out = numeric.mean_cross_entropy(table(spark, d, "embeddings"), "embedding", "label", 3)
    return out.select(F.round("loss", 6).alias("loss"), "n")


@query(f"WITH {_LANES}, y AS (SELECT vec_id i, j, 2.5 * v + v * v + CASE WHEN j % 2 = 0 THEN j ELSE 0 END v FROM x) SELECT j i, i j, round(v, 6) v FROM y")
def axpy_bias_transpose(spark, d):
    x = lanes(spark, d).select(F.col("vec_id").alias("i"), "j", "v")
    bias = spark.range(0, 1024, 2).select(F.col("id").alias("j"), F.col("id").cast("double").alias("v"))
    out = numeric.transposed(numeric.bias_added(numeric.axpy(2.5, x, x.withColumn("v", F.col("v") * F.col("v"))), bias))
    return out.select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH {_LANES}, m AS (SELECT label q, j, sum(v) / count(DISTINCT vec_id) x FROM x GROUP BY ALL), s AS (SELECT label q, vec_id // 40 block, vec_id, sum(v * m.x) dot FROM x JOIN m ON x.label = m.q AND x.j = m.j GROUP BY ALL),
b AS (SELECT q, block, sum(dot) / count(*) score FROM s GROUP BY ALL) SELECT q, block, round(score, 6) score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, block) AS INTEGER) "rank" FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, block) <= 3""")
def top_key_blocks(spark, d):
    rows = table(spark, d, "embeddings")
    found = numeric.top_blocks(rows.select(F.col("label").alias("q"), F.col("vec_id").alias("g"), F.col("embedding").alias("vector")), rows.select(F.col("label").alias("q"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector")), 40, 3)
    return found.select("q", "block", F.round("score", 6).alias("score"), "rank")


@query()
def fused_and_strict_products(spark, d):
    a, b, c = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    fused, strict = v.float_bits(v.fused_multiply_add(a, b, c)), v.float_bits(v.strict_multiply_add(a, b, c))
    rows = table(spark, d, "lineitem").select("l_linenumber", v.ulp_distance(fused, strict).alias("ulp"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("ulp") > 0).alias("apart"), F.max("ulp").alias("most"))
