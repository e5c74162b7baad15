"""Token, graph, interpreter and numeric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import graph as g
from lanewise.operators import interp, numeric
from lanewise.operators import tokens as tk
from lanewise.operators.trace import FEW, PIECE
from lanewise.plans.registry import query, table

@query("SELECT CAST(count(*) AS BIGINT) docs, CAST(sum(octet_length(encode(text)) + 2) AS BIGINT) tokens FROM documents")
def byte_token_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text") + 2).cast("long").alias("tokens"))


@query("""WITH x AS (SELECT doc_id, hex(encode(text)) h, octet_length(encode(text)) n FROM documents),
t AS (SELECT doc_id, p, CASE WHEN p = 0 THEN 256 WHEN p = n + 1 THEN 257 ELSE CAST(('0x' || substr(h, 2 * p - 1, 2)) AS INTEGER) END v, n FROM (SELECT doc_id, h, n, unnest(generate_series(0, CAST(n AS BIGINT) + 1)) p FROM x))
SELECT v a, nx b, count(*) n FROM (SELECT v, lead(v) OVER (PARTITION BY doc_id ORDER BY p) nx FROM t) WHERE nx IS NOT NULL GROUP BY ALL""")
def byte_bigram_counts(spark, d):
    return tk.bigrams(table(spark, d, "documents").select("text"))


_SIMPLE = r"[^\s]+"
_PRE = r"p AS (SELECT piece, count(*) n FROM (SELECT unnest(regexp_extract_all(text, '[^\s]+')) piece FROM documents) GROUP BY piece)"
_PAIRS = f"{_PRE}, s AS (SELECT piece, n, hex(encode(piece)) h, unnest(generate_series(1, CAST(octet_length(encode(piece)) AS BIGINT) - 1)) k FROM p), q AS (SELECT substr(h, 2 * k - 1, 2) a, substr(h, 2 * k + 1, 2) b, CAST(sum(n) AS BIGINT) n FROM s GROUP BY ALL)"


@query(f"WITH {_PRE} SELECT piece, n FROM p")
def pretoken_freq(spark, d):
    return tk.pretokens(table(spark, d, "documents"), pattern=_SIMPLE)


@query(f"WITH {_PAIRS} SELECT a, b, n FROM q")
def bpe_pair_counts(spark, d):
    return tk.pair_counts(tk.spelled(tk.pretokens(table(spark, d, "documents"), pattern=_SIMPLE)))


@query(f"WITH {_PAIRS} SELECT a, b, n FROM q ORDER BY n DESC, a, b LIMIT 1")
def bpe_merge_step_1(spark, d):
    return tk.pair_counts(tk.spelled(tk.pretokens(table(spark, d, "documents"), pattern=_SIMPLE))).orderBy(F.desc("n"), "a", "b").limit(1)


@query()
def bpe_train(spark, d):
    return tk.bpe_merges(table(spark, d, "documents"), vocab=16_384)


@query("SELECT doc_id, CAST(octet_length(encode(text)) + 2 AS BIGINT) n_tokens, CAST(sum(octet_length(encode(text)) + 2) OVER (ORDER BY doc_id) - octet_length(encode(text)) - 2 AS BIGINT) \"offset\" FROM documents")
def token_stream_offsets(spark, d):
    return tk.token_stream(table(spark, d, "documents"))


@query("SELECT count(*) docs, CAST(sum(octet_length(encode(text)) + 2) AS BIGINT) tokens, round(sum(length(text)) / sum(octet_length(encode(text)) + 2), 6) chars_per_token FROM documents")
def doc_chars_per_token(spark, d):
    t = table(spark, d, "documents")
    n = F.sum(F.octet_length("text") + 2)
    return t.agg(F.count("*").alias("docs"), n.cast("long").alias("tokens"), F.round(F.sum(F.length("text")) / n, 6).alias("chars_per_token"))


@query("SELECT item_id, text FROM benchmark")
def detokenise_round_trip(spark, d):
    return table(spark, d, "benchmark").select("item_id", tk.detokenize(tk.framed(F.col("text"))).alias("text"))


# a program table: an order is a function, its lines are blocks of a value and a terminator, jumps follow part and supplier
_LINES = """l AS (SELECT CAST(l_orderkey AS VARCHAR) func, CAST(l_linenumber AS BIGINT) block, min(l_returnflag) flag, CAST(min(l_partkey) AS BIGINT) part, CAST(min(l_suppkey) AS BIGINT) supp, CAST(min(l_quantity) AS BIGINT) qty FROM lineitem GROUP BY ALL),
t AS (SELECT *, 1 + part % 7 a, 1 + supp % 7 b FROM l)"""
_E = f"""{_LINES}, j AS (SELECT func, block src, a dst FROM t WHERE flag <> 'N' UNION SELECT func, block, b FROM t WHERE flag = 'R'),
e AS (SELECT DISTINCT j.func, src, dst FROM j JOIN l ON j.func = l.func AND j.dst = l.block), bl AS (SELECT func, block node FROM l), en AS (SELECT func, min(block) node FROM l GROUP BY func)"""
# a dominates b iff b is reachable, and unreachable without a
_DOM = """reach(func, node) AS (SELECT func, node FROM {en} UNION SELECT r.func, x.dst FROM reach r JOIN {e} x ON r.func = x.func AND r.node = x.src),
r(func, without, node) AS (SELECT n.func, b.node, n.node FROM {en} n JOIN reach b ON n.func = b.func AND b.node <> n.node UNION SELECT r.func, r.without, x.dst FROM r JOIN {e} x ON r.func = x.func AND r.node = x.src AND x.dst <> r.without),
dom AS (SELECT b.func, b.node, a.node dom FROM reach b JOIN reach a ON a.func = b.func WHERE a.node = b.node OR NOT EXISTS (SELECT 1 FROM r WHERE r.func = b.func AND r.without = a.node AND r.node = b.node)),
c AS (SELECT func, node, count(*) depth FROM dom GROUP BY ALL), near AS (SELECT d.func, d.node, arg_max(d.dom, c.depth) idom FROM dom d JOIN c ON d.func = c.func AND d.dom = c.node WHERE d.dom <> d.node GROUP BY ALL)"""
_FORWARD = f"{_E}, {_DOM.format(en='en', e='e')}"
# backwards from a virtual exit -1 that all blocks without an edge lead to
_BACKWARD = f"""{_E}, rv AS (SELECT func, dst src, src dst FROM e UNION SELECT bl.func, -1, bl.node FROM bl WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.func = bl.func AND e.src = bl.node)), ex AS (SELECT DISTINCT func, -1 node FROM bl),
{_DOM.format(en='ex', e='rv')}, ip AS (SELECT bl.func, bl.node, coalesce(near.idom, -1) ipdom FROM bl LEFT JOIN near ON bl.func = near.func AND bl.node = near.node)"""


def _by_function(spark, d, *columns):
    """lineitem's rows as (func, block, columns), a function's rows together; the pieces' number grows with the rows, so their size does not."""
    rows = table(spark, d, "lineitem")
    n, most = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col("l_orderkey").cast("string").alias("func"), F.col("l_linenumber").cast("long").alias("block"), *columns)
    return own.repartition(max(n // PIECE + 1, min(most, n // FEW + 1)), "func")


def _lines(spark, d):
    own = _by_function(spark, d, "l_returnflag", "l_partkey", "l_suppkey", "l_quantity").groupBy("func", "block")
    rows = own.agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").cast("long").alias("part"), F.min("l_suppkey").cast("long").alias("supp"), F.min("l_quantity").cast("long").alias("qty"))
    return rows.withColumns({"a": 1 + F.col("part") % 7, "b": 1 + F.col("supp") % 7})


def _program(spark, d, *extra):
    """insts of the program table: two a line, numbered 20 * order + 2 * line and one more."""
    rows = _lines(spark, d)
    none, first = F.lit(None).cast("long"), 20 * F.col("func").cast("long") + 2 * F.col("block")
    op = F.when(F.col("qty") % 4 == 0, "VectorTimesScalar").otherwise("FAdd")
    end = F.when(F.col("flag") == "N", "Return").when(F.col("flag") == "R", "BranchConditional").otherwise("Branch")
    made = {"pos": (F.lit(0), F.lit(1)), "inst": (first, first + 1), "op": (op, end), "type": (2 + F.col("qty") % 3, none), "result": (first, none), "imm0": (none, F.when(F.col("flag") != "N", F.col("a"))), "imm1": (none, F.when(F.col("flag") == "R", F.col("b")))}
    # the two come from one row, so the lines are made once
    both = F.array(*[F.struct(*[c[k].alias(n) for n, c in made.items()]) for k in range(2)])
    return rows.select("func", "block", F.inline(both), F.col("qty").cast("int").alias("line"), *extra)


def _graph(spark, d):
    lines = _by_function(spark, d).withColumnRenamed("block", "node")
    return g.cfg_edges(_program(spark, d)), lines.distinct(), lines.groupBy("func").agg(F.min("node").alias("node"))


@query(f"WITH {_E} SELECT func, src, dst FROM e")
def cfg_edges(spark, d):
    return g.cfg_edges(_program(spark, d))


@query(f"WITH RECURSIVE {_FORWARD} SELECT func, node, dom FROM dom")
def cfg_dominators(spark, d):
    edges, _, entries = _graph(spark, d)
    return g.dominators(edges, entries)


@query(f"WITH RECURSIVE {_FORWARD} SELECT c.func, c.node, coalesce(near.idom, c.node) idom FROM c LEFT JOIN near ON c.func = near.func AND c.node = near.node")
def cfg_idom(spark, d):
    edges, _, entries = _graph(spark, d)
    return g.immediate_dominators(edges, entries)


@query(f"WITH RECURSIVE {_BACKWARD} SELECT func, node, CAST(ipdom AS BIGINT) ipdom FROM ip")
def cfg_ipdom(spark, d):
    edges, blocks, _ = _graph(spark, d)
    return g.immediate_post_dominators(edges, blocks)


@query(f"""WITH RECURSIVE {_BACKWARD}, f(func, node, front, ipdom) AS (SELECT e.func, e.src, e.dst, ip.ipdom FROM e JOIN ip ON e.func = ip.func AND e.src = ip.node WHERE e.dst <> ip.ipdom
UNION SELECT f.func, f.node, e.dst, f.ipdom FROM f JOIN e ON f.func = e.func AND f.front = e.src WHERE e.dst <> f.ipdom) SELECT func, node, front FROM f""")
def thread_frontier(spark, d):
    edges, blocks, _ = _graph(spark, d)
    return g.thread_frontier(edges, g.immediate_post_dominators(edges, blocks))


# flaws: no terminator in every 11th line, an early one in every 13th, values unknown, unlinked or of another type by part
_INST = f"""{_LINES}, i AS (SELECT func, block, 20 * CAST(func AS BIGINT) + 2 * block id, part, supp, qty, flag FROM t),
x AS (SELECT func, block, 0 pos, id inst, CASE WHEN part % 13 = 0 THEN 'Kill' WHEN qty % 4 = 0 THEN 'VectorTimesScalar' ELSE 'FAdd' END op, 2 + qty % 3 "type", id result FROM i
UNION ALL SELECT func, block, 1, id + 1, CASE WHEN part % 11 = 0 THEN 'FAdd' WHEN flag = 'N' THEN 'Return' WHEN flag = 'R' THEN 'BranchConditional' ELSE 'Branch' END, NULL, NULL FROM i),
v AS (SELECT id "value", CASE WHEN part % 19 = 0 THEN 'Param' ELSE 'InstResult' END kind, CASE WHEN part % 23 = 0 THEN id + 1 ELSE id END inst, CASE WHEN supp % 7 = 0 THEN 9 ELSE 2 + qty % 3 END "type" FROM i WHERE part % 17 <> 0),
o AS (SELECT id inst, id - 2 "value" FROM i), m AS (SELECT x.inst, kind, v.inst vinst, v."type" vtype, x."type" itype FROM x LEFT JOIN v ON x.result = v."value" WHERE x.result IS NOT NULL)"""


@query(f"""WITH {_INST} SELECT 'no_blocks' "rule", 'empty' item UNION ALL SELECT 'empty_block', '99'
UNION ALL SELECT 'early_terminator', CAST(inst AS VARCHAR) FROM x WHERE pos = 0 AND op = 'Kill' UNION ALL SELECT 'no_terminator', CAST(inst AS VARCHAR) FROM x WHERE pos = 1 AND op = 'FAdd'
UNION ALL SELECT 'bad_operand', CAST(inst AS VARCHAR) FROM o WHERE NOT EXISTS (SELECT 1 FROM v WHERE v."value" = o."value") UNION ALL SELECT 'bad_result', CAST(inst AS VARCHAR) FROM m WHERE kind IS NULL
UNION ALL SELECT 'unlinked_result', CAST(inst AS VARCHAR) FROM m WHERE kind IS NOT NULL AND (kind <> 'InstResult' OR vinst IS DISTINCT FROM inst) UNION ALL SELECT 'type_mismatch', CAST(inst AS VARCHAR) FROM m WHERE kind IS NOT NULL AND vtype IS DISTINCT FROM itype""")
def uir_verify(spark, d):
    lines = _lines(spark, d).select("func", "block", "part", "supp", "qty", (20 * F.col("func").cast("long") + 2 * F.col("block")).alias("id"))
    insts = _program(spark, d, "part")
    flawed = F.when((F.col("pos") == 0) & (F.col("part") % 13 == 0), "Kill").when((F.col("pos") == 1) & (F.col("part") % 11 == 0), "FAdd").otherwise(F.col("op"))
    kind, to = F.when(F.col("part") % 19 == 0, "Param").otherwise("InstResult"), F.when(F.col("part") % 23 == 0, F.col("id") + 1).otherwise(F.col("id"))
    values = lines.where("part % 17 != 0").select(F.col("id").alias("value"), kind.alias("kind"), to.alias("inst"), F.when(F.col("supp") % 7 == 0, F.lit(9).cast("long")).otherwise(2 + F.col("qty") % 3).alias("type"))
    operands = lines.select(F.col("id").alias("inst"), F.lit(0).alias("pos"), (F.col("id") - 2).alias("value"))
    funcs = lines.select("func").distinct().unionByName(spark.sql("SELECT 'empty' AS func"))
    blocks = lines.select("func", "block").unionByName(lines.groupBy().agg(F.min("func").alias("func"), F.lit(99).cast("long").alias("block")))
    return g.verify(funcs, blocks, insts.withColumn("op", flawed).drop("part"), operands, values)


_TYPES = [(2, "Float", None), (3, "Vector", 2), (4, "Struct", None)]
_SITES = f"{_LINES}, s AS (SELECT row_number() OVER (ORDER BY func, block) - 1 site_id, func, block, 20 * CAST(func AS BIGINT) + 2 * block inst, CASE WHEN qty % 4 = 0 THEN 'VectorTimesScalar' ELSE 'FAdd' END def_op, CAST(qty AS INTEGER) line FROM t WHERE qty % 3 < 2)"


def _types(spark):
    return spark.createDataFrame(_TYPES, "type long, kind string, elem long")


@query(f'WITH {_SITES} SELECT site_id, func, inst, inst "value", def_op, line FROM s')
def tap_sites(spark, d):
    return g.tap_sites(_program(spark, d), _types(spark))


@query(f"""WITH {_SITES}, p AS (SELECT func, block, 0 k, CASE WHEN qty % 4 = 0 THEN 'VectorTimesScalar' ELSE 'FAdd' END op, NULL site FROM t UNION ALL SELECT func, block, 1, 'TraceTap', site_id FROM s
UNION ALL SELECT func, block, 2, CASE WHEN flag = 'N' THEN 'Return' WHEN flag = 'R' THEN 'BranchConditional' ELSE 'Branch' END, NULL FROM t)
SELECT func, block, CAST(row_number() OVER (PARTITION BY func, block ORDER BY k) - 1 AS INTEGER) pos, op, CAST(site AS BIGINT) site FROM p""")
def taps_inserted(spark, d):
    none = spark.createDataFrame([], "inst long, pos int, value long")
    insts, _ = g.insert_taps(_program(spark, d), _types(spark), none)
    return insts.select("func", "block", "pos", "op", F.when(F.col("op") == "TraceTap", F.col("imm0")).alias("site"))


SIMPLE_PROGRAM = [
    {"op": "AccessChain", "result": "p", "operands": ["pc"], "imm": 0},
    {"op": "Load", "result": "k", "operands": ["p"]},
    {"op": "Load", "result": "uv", "operands": ["uv"]},
    {"op": "CompositeExtract", "result": "x", "operands": ["uv"], "imm": 0},
    {"op": "CompositeExtract", "result": "y", "operands": ["uv"], "imm": 1},
    {"op": "CompositeConstruct", "result": "v", "operands": ["x", "y", "half"]},
    {"op": "VectorTimesScalar", "result": "s", "operands": ["v", "k"]},
    {"op": "TraceTap", "operands": ["s"], "imm": 7},
    {"op": "CompositeConstruct", "result": "out", "operands": ["s", "one"]},
    {"op": "Store", "operands": ["color", "out"]},
    {"op": "Return"},
]


@query("""SELECT lane, CAST(CAST(CAST((lane % 16 + 0.5) / 16 AS FLOAT) * 2::FLOAT AS FLOAT) AS DOUBLE) r, CAST(CAST(CAST((lane // 16 + 0.5) / 16 AS FLOAT) * 2::FLOAT AS FLOAT) AS DOUBLE) g, 1.0::DOUBLE b, 1.0::DOUBLE a
FROM (SELECT unnest(generate_series(0, 255)) lane)""")
def interp_grid(spark, d):
    lanes = interp.grid(spark, 16).withColumn("pc", F.array(F.lit(2.0).cast("float")))
    out = interp.run(lanes, SIMPLE_PROGRAM, {"half": [0.5], "one": [1.0]}, {"uv": "uv", "pc": "pc"})
    return out.select("lane", *[F.get("color", F.lit(k)).cast("double").alias(c) for k, c in enumerate("rgba")])


@query("WITH x AS (SELECT vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 64 + 1e-6) s FROM embeddings) SELECT vec_id, k lane, round(CAST(e[k + 1] AS DOUBLE) / s, 6) y FROM (SELECT *, unnest(generate_series(0, 63)) k FROM x)")
def rmsnorm_embed(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(numeric.rms_norm(F.col("embedding"))).alias("lane", "y")).select("vec_id", F.col("lane").cast("long").alias("lane"), F.round("y", 6).alias("y"))


@query("""WITH x AS (SELECT vec_id, label, CAST(list_max(embedding) AS DOUBLE) m, embedding e FROM embeddings)
SELECT vec_id, round(m + ln(list_sum(list_transform(e, lambda v: exp(CAST(v AS DOUBLE) - m)))) - CAST(e[label + 1] AS DOUBLE), 6) loss FROM x""")
def softmax_xent(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) best FROM embeddings")
def argmax_vocab(spark, d):
    return table(spark, d, "embeddings").select("vec_id", numeric.argmax(F.col("embedding")).alias("best"))


_TP = """x AS (SELECT vec_id, unnest(generate_series(0, 63)) token, unnest(list_transform(embedding, lambda v: exp(8 * CAST(v AS DOUBLE)))) w FROM embeddings),
p AS (SELECT vec_id, token, w / sum(w) OVER (PARTITION BY vec_id) p FROM x), k AS (SELECT *, least(15, greatest(0, CAST(floor(-log2(p)) AS INTEGER))) bucket FROM p WHERE p > 0.0005),
m AS (SELECT vec_id, bucket, sum(p) mass FROM k GROUP BY ALL), c AS (SELECT *, sum(mass) OVER (PARTITION BY vec_id ORDER BY bucket) - mass below FROM m)"""


@query(f"WITH {_TP} SELECT vec_id, token, bucket, round(p / sum(p) OVER (PARTITION BY vec_id), 6) q FROM (SELECT k.* FROM k JOIN c ON k.vec_id = c.vec_id AND k.bucket = c.bucket WHERE round(below, 12) < 0.7)")
def topp_buckets(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "x"))
    weight = rows.withColumn("w", F.exp(8 * F.col("x").cast("double")))
    total = weight.groupBy("vec_id").agg(F.sum("w").alias("t"))
    probs = weight.join(total, "vec_id").select("vec_id", F.col("token").cast("long").alias("token"), (F.col("w") / F.col("t")).alias("p"))
    return numeric.top_p(probs, 0.7, 0.0005, ["vec_id"]).select("vec_id", "token", "bucket", F.round("q", 6).alias("q"))


@query("SELECT lane j, round(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) norm FROM (SELECT unnest(generate_series(0, 63)) lane, unnest(embedding) x FROM embeddings) GROUP BY lane")
def column_norms(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return numeric.column_norms(rows).select(F.col("j").cast("long").alias("j"), F.round("norm", 6).alias("norm"))


@query("""WITH w AS (SELECT vec_id i, unnest(generate_series(0, 63)) j, unnest(embedding) v FROM embeddings), m AS (SELECT j, sqrt(sum(CAST(v AS DOUBLE) * v)) m FROM w GROUP BY j),
v AS (SELECT i, j, CAST(v AS DOUBLE) + ((i % 3) * 0.1::DOUBLE) * ((j % 5) * 0.2::DOUBLE) v FROM w), n AS (SELECT j, sqrt(sum(v * v)) n FROM v GROUP BY j)
SELECT v.i, v.j, round(CASE WHEN n > 0 THEN v * m / n ELSE 0 END, 6) v FROM v JOIN n ON v.j = n.j JOIN m ON v.j = m.j""")
def dora_effective_weight(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    b = rows.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"), ((F.col("i") % 3) * 0.1).alias("v"))
    a = spark.range(64).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), ((F.col("id") % 5) * 0.2).alias("v"))
    magnitude = numeric.column_norms(rows).withColumnRenamed("norm", "m")
    return numeric.dora_weight(rows, b, a, magnitude).select("i", "j", F.round("v", 6).alias("v"))


@query("""WITH x AS (SELECT doc_id, hex(encode(text)) h, octet_length(encode(text)) n FROM documents),
t AS (SELECT doc_id, p, CASE WHEN p = 0 THEN 256 WHEN p = n + 1 THEN 257 ELSE CAST(('0x' || substr(h, 2 * p - 1, 2)) AS INTEGER) END v, n FROM (SELECT doc_id, h, n, unnest(generate_series(0, CAST(n AS BIGINT) + 1)) p FROM x)),
b AS (SELECT v a, nx b, count(*) n FROM (SELECT v, lead(v) OVER (PARTITION BY doc_id ORDER BY p) nx FROM t) WHERE nx IS NOT NULL GROUP BY ALL), s AS (SELECT a, sum(n) t FROM b GROUP BY a)
SELECT round(sum(-n * ln(greatest((n + 1) / (t + 258), 1e-12))) / sum(n), 6) loss FROM b JOIN s ON b.a = s.a""")
def bigram_lm_loss(spark, d):
    return numeric.bigram_loss(tk.bigrams(table(spark, d, "documents").select("text"))).select(F.round("loss", 6).alias("loss"))


@query("WITH t AS (SELECT sqrt(sum((l_discount - 0.05) * (l_discount - 0.05))) n FROM lineitem) SELECT l_linenumber, round(sum((l_discount - 0.05) * least(1, 10 / ((SELECT n FROM t) + 1e-6))), 6) g FROM lineitem GROUP BY l_linenumber")
def grad_clip(spark, d):
    grads = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") - 0.05).alias("g"))
    return numeric.clip_by_norm(grads, 10.0).groupBy("l_linenumber").agg(F.round(F.sum("g"), 6).alias("g"))


@query("""WITH s AS (SELECT l_linenumber, l_quantity w, l_discount - 0.05 g FROM lineitem), u AS (SELECT *, 0.1::DOUBLE * g m, 0.001::DOUBLE * g * g v FROM s)
SELECT l_linenumber, round(sum(w * (1 - 1e-3 * 0.01) - 1e-3 * (m / (1 - 0.9::DOUBLE)) / (sqrt(v / (1 - 0.999::DOUBLE)) + 1e-8)), 4) w FROM u GROUP BY l_linenumber""")
def adamw_step(spark, d):
    params = table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_discount") - 0.05).alias("g"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return numeric.adamw(params, 1).groupBy("l_linenumber").agg(F.round(F.sum("w"), 4).alias("w"))


@query("SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))), 6) logit FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def lm_head_logits(spark, d):
    rows = table(spark, d, "embeddings")
    head = rows.where("vec_id = 0").select("embedding").limit(1).scalar()
    # the one row is a scalar subquery, held in a column as lambdas cannot hold a subquery
    return rows.withColumn("head", head).select("vec_id", F.round(numeric.dot(F.col("embedding"), F.col("head")), 6).alias("logit"))
