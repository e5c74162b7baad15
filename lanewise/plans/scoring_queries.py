"""Scoring queries: candidates are documents with their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions.values import normalize_ulp
from lanewise.operators import scoring as sc
from lanewise.plans.registry import query, table

_CAND = """c AS (SELECT d.doc_id, d.source, coalesce(l.quality, 0) = 1 compiled, coalesce(l.quality, 0) = 1 AND n_chars % 3 <> 0 executed,
(n_chars % 101) / 100.0::DOUBLE divergence, (n_chars % 57) / 50.0::DOUBLE numerical_error, (n_chars % 29) / 28.0::DOUBLE visual_match, coalesce(l.toxic, 0)::DOUBLE perf_penalty FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_CL = "greatest(0, least(1, {}))"
_REW = f"""{_CAND}, r AS (SELECT *, CASE WHEN compiled THEN 1.0::DOUBLE ELSE 0 END r_compile, CASE WHEN compiled AND executed THEN 1.0::DOUBLE ELSE 0 END r_exec,
CASE WHEN compiled THEN 0.5 * (1 - {_CL.format('divergence')}) ELSE 0 END r_divergence, CASE WHEN compiled THEN 1 - {_CL.format('numerical_error')} ELSE 0 END r_numerical,
CASE WHEN compiled THEN 2 * {_CL.format('visual_match')} ELSE 0 END r_visual, CASE WHEN compiled THEN -0.2 * {_CL.format('perf_penalty')} ELSE 0 END + 0.0::DOUBLE r_perf FROM c),
s AS (SELECT *, r_compile + r_exec + r_divergence + r_numerical + r_visual + r_perf total FROM r)"""
_ATT = "a AS (SELECT d.source, d.doc_id // 8 prompt, d.doc_id % 8 + 1 attempt, coalesce(l.quality, 0) = 1 ok FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def candidates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    ok = F.coalesce("quality", F.lit(0)) == 1
    n = F.col("n_chars")
    return rows.select("doc_id", "source", ok.alias("compiled"), (ok & (n % 3 != 0)).alias("executed"), ((n % 101) / 100.0).alias("divergence"), ((n % 57) / 50.0).alias("numerical_error"), ((n % 29) / 28.0).alias("visual_match"), F.coalesce("toxic", F.lit(0)).cast("double").alias("perf_penalty"))


def attempts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("source", F.floor(F.col("doc_id") / 8).alias("prompt"), (F.col("doc_id") % 8 + 1).alias("attempt"), (F.coalesce("quality", F.lit(0)) == 1).alias("ok"))


_PARTS = ["r_compile", "r_exec", "r_divergence", "r_numerical", "r_visual", "r_perf", "total"]


@query(f"WITH {_REW} SELECT doc_id, {', '.join(f'round({p}, 9) {p}' for p in _PARTS)} FROM s")
def reward_breakdown(spark, d):
    return sc.reward(candidates(spark, d)).select("doc_id", *[F.round(p, 9).alias(p) for p in _PARTS])


@query(f"WITH {_REW} SELECT compiled, count(*) n, round(max(total), 9) best FROM s GROUP BY compiled")
def reward_gate(spark, d):
    return sc.reward(candidates(spark, d)).groupBy("compiled").agg(F.count("*").alias("n"), F.round(F.max("total"), 9).alias("best"))


@query(f"WITH {_REW} SELECT source, count(*) n, round(avg(total), 6) mean_reward, round(avg(CASE WHEN compiled THEN 1.0::DOUBLE ELSE 0 END), 6) compile_rate FROM s GROUP BY source")
def reward_by_source(spark, d):
    return sc.reward(candidates(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean_reward"), F.round(F.avg(F.col("compiled").cast("double")), 6).alias("compile_rate"))


@query(f"WITH {_REW} SELECT CASE WHEN total >= 3 THEN 'runs' WHEN total >= 1 THEN 'compiles' ELSE 'broken' END verdict, count(*) n FROM s GROUP BY 1")
def verdict_bands(spark, d):
    return sc.reward(candidates(spark, d)).groupBy(sc.verdict(F.col("total")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber idx, max(l_discount) err FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY err DESC, idx) k FROM e)
SELECT l_orderkey, idx, 100 + idx site_id, 10 * idx line, err severity FROM r WHERE k = 1 AND err > 0""")
def blame_worst_site(spark, d):
    errors = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("idx")).agg(F.max("l_discount").alias("err"))
    sites = spark.range(1, 8).select(F.col("id").cast("int").alias("idx")).select("idx", (100 + F.col("idx")).alias("site_id"), (10 * F.col("idx")).alias("line"))
    return sc.worst_site(errors, sites, ["l_orderkey"])


@query("SELECT x ulp, round(CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-x / 16.0::DOUBLE) END, 9) penalty FROM (SELECT CAST(unnest(generate_series(-5, 200)) AS DOUBLE) x)")
def normalize_ulp_curve(spark, d):
    return spark.range(-5, 201).select(F.col("id").cast("double").alias("ulp")).select("ulp", F.round(normalize_ulp(F.col("ulp")), 9).alias("penalty"))


_ATK = f"{_ATT}, p AS (SELECT prompt, bool_or(ok AND attempt = 1) f, bool_or(ok) y, min(CASE WHEN ok THEN attempt END) t FROM a WHERE attempt <= 4 GROUP BY prompt)"


@query(f"WITH {_ATK} SELECT count(*) n, round(avg(f::INT), 4) compile_at_1, round(avg(y::INT), 4) compile_at_k FROM p")
def compile_at_1_k(spark, d):
    return sc.compile_at_k(attempts(spark, d), 4).select("n", F.round("compile_at_1", 4).alias("compile_at_1"), F.round("compile_at_k", 4).alias("compile_at_k"))


@query(f"WITH {_ATK} SELECT round(avg(coalesce(t, 4)), 6) mean_attempts FROM p")
def mean_attempts(spark, d):
    return sc.compile_at_k(attempts(spark, d), 4).select(F.round("mean_attempts", 6).alias("mean_attempts"))


@query(f"WITH {_REW} SELECT doc_id, round((total - avg(total) OVER (PARTITION BY source)) / (stddev_pop(total) OVER (PARTITION BY source) + 1e-6), 6) advantage FROM s")
def grpo_advantage(spark, d):
    return sc.group_advantage(sc.reward(candidates(spark, d)), "source", "total").select("doc_id", F.round("advantage", 6).alias("advantage"))


@query(f"""WITH {_ATT}, p AS (SELECT source, prompt, bool_or(ok AND attempt = 1) f, bool_or(ok) y FROM a WHERE attempt <= 8 GROUP BY ALL), m AS (SELECT unnest(['src0', 'src1', 'src2', 'srcX']) source)
SELECT m.source, count(prompt) n, coalesce(CAST(round(avg(f::INT), 4) AS VARCHAR), 'n/a') <> 'n/a' measured, round(avg(f::INT), 4) compile_at_1, round(avg(y::INT), 4) compile_at_k FROM m LEFT JOIN p ON m.source = p.source GROUP BY m.source""")
def model_comparison(spark, d):
    expected = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("srcX",)], "source string")
    own = sc.compile_at_k(attempts(spark, d), 8, ["source"])
    return expected.join(own, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNotNull().alias("measured"), F.round("compile_at_1", 4).alias("compile_at_1"), F.round("compile_at_k", 4).alias("compile_at_k"))


@query(f"""WITH {_ATT}, f AS (SELECT prompt, min(attempt) rd FROM a WHERE ok GROUP BY prompt), r AS (SELECT DISTINCT attempt rd FROM a), n AS (SELECT r.rd, count(prompt) newly FROM r LEFT JOIN f ON r.rd = f.rd GROUP BY r.rd),
t AS (SELECT count(DISTINCT prompt) n FROM a), c AS (SELECT rd, newly, sum(newly) OVER (ORDER BY rd) verified FROM n)
SELECT rd "round", newly, CAST(verified AS BIGINT) verified, CAST(n - verified AS BIGINT) pending, round(verified / n, 6) "yield" FROM c, t""")
def verified_yield(spark, d):
    out = sc.yield_by_round(attempts(spark, d).withColumnRenamed("attempt", "round"))
    return out.select("round", "newly", "verified", "pending", F.round("yield", 6).alias("yield"))


@query("SELECT quality = 1 ok, count(*) n, round(count(*) / (SELECT count(*) FROM labels), 4) rate FROM labels GROUP BY 1")
def label_stats(spark, d):
    labels = table(spark, d, "labels")
    total = labels.agg(F.count("*").alias("n")).scalar()
    return labels.groupBy((F.col("quality") == 1).alias("ok")).agg(F.count("*").alias("n")).select("ok", "n", F.round(F.col("n") / total, 4).alias("rate"))


@query("SELECT count(*) n_broken, count(*) FILTER (WHERE toxic = 0) repaired_ok, round(avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) rate FROM labels WHERE NOT coalesce(quality = 1, true)")
def repair_stats(spark, d):
    broken = table(spark, d, "labels").where(~F.coalesce(F.col("quality") == 1, F.lit(True)))
    return broken.agg(F.count("*").alias("n_broken"), F.count_if(F.col("toxic") == 0).alias("repaired_ok"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 4).alias("rate"))


@query("""WITH x AS (SELECT vec_id, count_if(isfinite(v)) = count(*) ok, var_pop(CAST(v AS DOUBLE)) var FROM (SELECT vec_id, unnest(embedding) v FROM embeddings) GROUP BY vec_id)
SELECT vec_id, ok executed, round(CASE WHEN ok THEN 1 - exp(-32 * var) ELSE 0 END, 9) credit FROM x""")
def visual_credit_embed(spark, d):
    lanes = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    from lanewise.functions.values import finite

    own = lanes.groupBy("vec_id").agg(F.bool_and(finite(F.col("x"))).alias("executed"), F.var_pop(F.col("x").cast("double")).alias("variance"))
    return own.select("vec_id", "executed", F.round(sc.visual_credit(F.col("executed"), F.col("variance")), 9).alias("credit"))
