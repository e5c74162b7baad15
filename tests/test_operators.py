import random

import pytest
from pyspark.sql import functions as F

from lanewise.functions.opcodes import EXPRESSIONS, OPCODES
from lanewise.operators import corpus, graph, interp, numeric, rounds, scoring, tokens, trace
from lanewise.plans.kernel_queries import SIMPLE_PROGRAM
from lanewise.sources import corpora
from lanewise.streaming import streams

CAND = "compiled boolean, executed boolean, divergence double, numerical_error double, visual_match double, perf_penalty double"


def total(spark, *row):
    return scoring.reward(spark.createDataFrame([row], CAND)).first()


def test_reward(spark):
    assert total(spark, True, True, 0.0, 0.0, 1.0, 0.0).total == 5.5
    r = total(spark, False, False, 0.9, 1.0, 0.0, 1.0)
    assert (r.total, r.r_exec) == (0, 0)
    assert total(spark, True, True, 0.0, 0.0, 0.2, 0.0).total < total(spark, True, True, 0.0, 0.0, 0.9, 0.0).total
    assert total(spark, True, True, 0.1, 0.0, 1.0, 0.0).total > total(spark, True, True, 0.8, 0.0, 1.0, 0.0).total
    assert total(spark, True, False, 0.0, 0.0, 0.0, 0.0).total == 2.5
    assert total(spark, True, True, -3.0, 7.0, 9.0, 5.0).total == 1 + 1 + 0.5 + 0 + 2 - 0.2


def test_blame(spark):
    sites = spark.createDataFrame([(0, 0, 5), (1, 1, 6), (2, 2, 7)], "idx int, site_id int, line int")
    errors = lambda *e: spark.createDataFrame(list(enumerate(e)), "idx int, err double")
    r = scoring.worst_site(errors(0.01, 0.5, 0.02), sites).first()
    assert (r.site_id, r.line, r.severity) == (1, 6, 0.5)
    assert scoring.worst_site(errors(0.5, 0.5), sites).first().site_id == 0
    assert scoring.worst_site(errors(0.0, 0.0), sites).count() == 0
    assert scoring.worst_site(errors(0.0, 0.1, 0.1, 0.9), sites).count() == 0


def test_compile_at_k_and_yield(spark):
    rows = [(p, 1, p < 4) for p in range(8)] + [(p, 2, True) for p in range(4, 8)]
    a = spark.createDataFrame(rows, "prompt int, attempt int, ok boolean")
    r = scoring.compile_at_k(a, 3).first()
    assert (r.n, r.compile_at_1, r.compile_at_k, r.mean_attempts) == (8, 0.5, 1.0, 1.5)
    y = scoring.yield_by_round(a.withColumnRenamed("attempt", "round")).orderBy("round").collect()
    assert [(r.newly, r.verified, r.pending) for r in y] == [(4, 4, 4), (4, 8, 0)]


def test_advantage(spark):
    rows = spark.createDataFrame([("g", float(k)) for k in range(4)], "g string, r double")
    got = [r.advantage for r in scoring.group_advantage(rows, "g", "r").orderBy("r").collect()]
    assert abs(sum(got)) < 1e-9 and got == sorted(got) and got[0] < got[-1]


def dedup_brute(rows):
    ids, hashes, out = set(), set(), []
    for seq, i, h in rows:
        if (i and i in ids) or h in hashes:
            continue
        hashes.add(h)
        if i:
            ids.add(i)
        out.append(seq)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_two_key_dedup(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(k, r.choice([None, "", "a", "b", "c"]), r.choice("wxyz")) for k in range(12)]
    df = spark.createDataFrame(rows, "seq int, id string, hash string")
    assert sorted(x.seq for x in corpus.dedup(df).collect()) == dedup_brute(rows)


def test_corpus_pieces(spark):
    one = lambda col, **k: spark.range(1).select(*[F.lit(x).alias(n) for n, x in k.items()]).select(col.alias("x")).first().x
    assert one(corpus.code_hash(F.col("c")), c=" a \n\t b ") == one(corpus.code_hash(F.col("c")), c="a b")
    assert one(corpus.balanced(F.col("c")), c="f{a{}b} rest}") == "f{a{}b}"
    assert one(corpus.balanced(F.col("c")), c="none") == "none"
    assert one(corpus.shape_of(F.col("c")), c="void main ( )") == "own_main" and one(corpus.shape_of(F.col("c")), c="x") == "snippet"
    assert one(corpus.to_main_image(F.col("c")), c="#version 450\n  uniform float x;\nvoid mainImage()\n#define iTimeDelta 1\npush_constant y") == "void mainImage()"
    assert one(corpus.shader_body(F.col("c")), c="a void main() b") == "a "
    assert one(corpus.parse_tags(F.col("c")), c="['a', 'b']") == ["a", "b"] and one(corpus.parse_tags(F.col("c")), c="plain") == ["plain"] and one(corpus.parse_tags(F.col("c")), c="") == []
    assert one(corpus.is_meaningful(F.col("c")), c="  short;  ") is False and one(corpus.is_meaningful(F.col("c")), c="float x = 1.0; // long") is True
    record, prompt = corpus.record_of(F.col("n"), F.col("d"), F.array(F.lit("t")), F.col("c"))
    assert one(record, n=" My\nshader ", d="line one\nline two", c="code \n") == "// Shader: My shader\n// line one\n// tags: t\ncode\n"
    assert corpus.allocate(13, list("abcde")) == {"a": 3, "b": 3, "c": 3, "d": 2, "e": 2}
    passes = spark.createDataFrame([([("image", "I"), ("weird", "W"), ("common", "C"), ("buffer", "B")],)], "p array<struct<type:string,code:string>>")
    assert passes.select(corpus.join_passes(F.col("p")).alias("x")).first().x == "C\n\nB\n\nW\n\nI"


def test_split_is_a_cut(spark):
    rows = spark.range(200).select(F.col("id").alias("seq"), F.col("id"), F.lit("n").alias("name"))
    got = corpus.deterministic_split(rows, 0.1).orderBy("split_key", "seq").collect()
    assert [r.is_val for r in got] == [k < 20 for k in range(200)]
    assert not any(r.is_val for r in corpus.deterministic_split(rows.limit(3), 0.1).collect())


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "é🙂"), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.ids for r in docs.select("doc_id", tokens.framed(F.col("text")).alias("ids")).collect()}
    assert got == {1: [256, 97, 98, 257], 2: [256, *"é🙂".encode(), 257], 3: [256, 257]}
    assert [r.x for r in docs.select("doc_id", tokens.detokenize(tokens.framed(F.col("text"))).alias("x")).orderBy("doc_id").collect()] == ["ab", "é🙂", ""]
    assert [(r.n_tokens, r.offset) for r in tokens.token_stream(docs).orderBy("doc_id").collect()] == [(4, 0), (8, 4), (2, 12)]


def test_bpe_training(spark):
    docs = spark.createDataFrame([("low low lower",), ("aaa aaa",)], "text string")
    got = tokens.train_bpe(docs, 5)
    # by hand: 'aa' has 4; then 'lo' and 'ow' have 3 and the first in order wins; then 'low'
    assert got[:3] == [("61", "61", 4), ("6C", "6F", 3), ("6C6F", "77", 3)]
    assert all(n >= 2 for *_, n in got)
    assert tokens.train_bpe(docs.limit(0), 3) == []
    assert spark.range(1).select(tokens.merge_pair(F.split(F.lit("a a a b"), " "), "a", "a").alias("x")).first().x == ["aa", "a", "b"]


def test_graph_unreachable(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 5, 1)], "func string, src long, dst long")
    entries = spark.createDataFrame([("f", 0)], "func string, node long")
    got = {(r.node, r.dom) for r in graph.dominators(edges, entries).collect()}
    assert got == {(0, 0), (1, 0), (1, 1)}


def random_graphs(spark):
    r = random.Random(5)
    edges, blocks = set(), []
    for k in range(30):
        n = r.randint(1, 9)
        blocks += [(f"f{k}", b) for b in range(n)]
        edges |= {(f"f{k}", r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 2 * n))}
    edges |= {("long", k, k + 1) for k in range(50)}
    blocks += [("long", k) for k in range(51)]
    frame = spark.createDataFrame(sorted(edges), "func string, src long, dst long")
    return edges, blocks, frame, spark.createDataFrame(blocks, "func string, node long")


def reach(edges, func, starts, without=None):
    seen, left = set(), [s for s in starts if s != without]
    while left:
        at = left.pop()
        if at not in seen:
            seen.add(at)
            left += [d for f, s, d in edges if (f, s) == (func, at) and d != without]
    return seen


def brute_dominators(edges, func, starts):
    all_ = reach(edges, func, starts)
    lost = {a: all_ - reach(edges, func, starts, a) for a in all_}
    return {(b, a) for a in all_ for b in lost[a] | {a}}


def nearest(dom):
    depth = {b: sum(x == b for x, _ in dom) for b, _ in dom}
    return {b: max((a for x, a in dom if x == b and a != b), key=depth.get, default=b) for b in depth}


def one_pass(monkeypatch, spark):
    """No rounds: nothing may be cut; and functions that go on over several batches."""
    monkeypatch.setattr(rounds, "durable", None)
    monkeypatch.setattr(graph, "durable", None, raising=False)
    monkeypatch.setattr(graph, "BATCH", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    return lambda: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_idoms_in_one_pass(spark, monkeypatch):
    edges, blocks, frame, _ = random_graphs(spark)
    entries = spark.createDataFrame([(f, 0) for f in {f for f, _ in blocks}], "func string, node long")
    undo = one_pass(monkeypatch, spark)
    got = {(r.func, r.node): r.idom for r in graph.immediate_dominators(frame, entries).collect()}
    pairs = [(r.func, r.node, r.dom) for r in graph.dominators(frame, entries).collect()]
    found = {tuple(r) for r in graph.reachable(frame, entries).collect()}
    undo()
    want = {f: brute_dominators(edges, f, [0]) for f in {f for f, _ in blocks}}
    assert got == {(f, b): a for f, dom in want.items() for b, a in nearest(dom).items()}
    assert sorted(pairs) == sorted((f, b, a) for f, dom in want.items() for b, a in dom)
    assert found == {(f, b) for f, dom in want.items() for b, _ in dom}


def test_ipdoms_in_one_pass(spark, monkeypatch):
    edges, blocks, frame, nodes = random_graphs(spark)
    undo = one_pass(monkeypatch, spark)
    got = [tuple(r) for r in graph.immediate_post_dominators(frame, nodes).collect()]
    undo()
    want = []
    for f in {f for f, _ in blocks}:
        own = [b for g, b in blocks if g == f]
        back = {(f, d, s) for g, s, d in edges if g == f} | {(f, -1, b) for b in own if not any((g, s) == (f, b) for g, s, _ in edges)}
        near = nearest(brute_dominators(back, f, [-1]))
        want += [(f, b, near.get(b, -1)) for b in own]
    assert sorted(got) == sorted(want)


def test_frontiers_in_one_pass(spark, monkeypatch):
    edges, blocks, frame, nodes = random_graphs(spark)
    ends = {(f, b): (b * 7 + 3) % 5 for f, b in blocks}
    ipdom = spark.createDataFrame([(f, b, e) for (f, b), e in ends.items()], "func string, node long, ipdom long")
    undo = one_pass(monkeypatch, spark)
    got = [tuple(r) for r in graph.thread_frontier(frame, ipdom).collect()]
    undo()
    want = [(f, b, x) for (f, b), e in ends.items() for x in reach(edges, f, [d for g, s, d in edges if (g, s) == (f, b)], e)]
    assert sorted(got) == sorted(want)


def test_taps_continue(spark):
    insts = spark.createDataFrame([("f", 0, k, k, "FAdd", 1, 10 + k, None, None, k) for k in range(3)], "func string, block long, pos int, inst long, op string, type long, result long, imm0 long, imm1 long, line int")
    types = spark.createDataFrame([(1, "Float", None)], "type long, kind string, elem long")
    first = graph.tap_sites(insts, types, accept=F.col("line") < 2)
    assert [(r.site_id, r.value) for r in first.orderBy("site_id").collect()] == [(0, 10), (1, 11)]
    more = graph.tap_sites(insts, types, tapped=first)
    assert [(r.site_id, r.value) for r in more.collect()] == [(2, 12)]


def test_interpreter(spark):
    lanes = spark.createDataFrame([(0, [0.3, 0.7], [2.0])], "lane long, uv array<float>, pc array<float>")
    r = interp.run(lanes, SIMPLE_PROGRAM, {"half": [0.5], "one": [1.0]}, {"uv": "uv", "pc": "pc"}).first()
    assert r.color == pytest.approx([0.6, 1.4, 1.0, 1.0], abs=1e-6) and len(r.tap_7) == 3
    r = interp.run(lanes, [{"op": "Sin", "result": "s", "operands": ["x"]}, {"op": "Store", "operands": ["o", "s"]}]).first()
    assert r.o == [0.0]
    p = interp.probe(interp.grid(spark, 4).withColumn("rgb", F.array(F.get("uv", F.lit(0)), F.lit(0.0), F.lit(0.0))), []).first()
    assert p.samples == 16 and p.finite and p.variance > 0


def val(spark, op, *args):
    arrays = [F.array(*[F.lit(x).cast("float" if isinstance(x, float) else "int") for x in a]) if isinstance(a, list) else a for a in args]
    return spark.range(1).select(EXPRESSIONS[op](*arrays).alias("x")).first().x


CASES = [
    ("IAdd", [2**31 - 1], [1], [-(2**31)]), ("IMul", [65536], [65536], [0]), ("SDiv", [-7], [2], [-3]), ("SMod", [-7], [2], [1]), ("UDiv", [-1], [2], [2**31 - 1]), ("UMod", [7], [0], [0]),
    ("FDiv", [1.0], [0.0], [float("inf")]), ("FAdd", [1.0, 2.0], [3.0], [4.0, 5.0]), ("ULessThan", [-1], [1], [0]), ("SLessThan", [-1], [1], [1]), ("FOrdEqual", [float("nan")], [float("nan")], [0]),
    ("ShiftLeftLogical", [1], [31], [-(2**31)]), ("ShiftRightLogical", [-1], [28], [15]), ("ShiftRightArithmetic", [-16], [2], [-4]), ("BitwiseXor", [6], [3], [5]),
    ("Dot", [1.0, 2.0], [3.0, 4.0], [11.0]), ("Cross", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]), ("Distance", [0.0, 0.0], [3.0, 4.0], [5.0]), ("Reflect", [1.0, -1.0], [0.0, 1.0], [1.0, 1.0]), ("Step", [0.5], [0.2, 0.7], [0.0, 1.0]), ("FMin", [1.0, 5.0], [3.0], [1.0, 3.0]), ("LogicalAnd", [1], [0], [0]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_opcodes(spark, case):
    op, *args, want = case
    assert val(spark, op, *args) == pytest.approx(want)


def test_more_opcodes(spark):
    assert len(OPCODES) == len(set(OPCODES)) == 101
    assert val(spark, "ConvertFToS", [-2.7]) == [-2] and val(spark, "Bitcast", [0x3F800000]) == [1.0] and val(spark, "Not", [0]) == [-1]
    assert val(spark, "Log", [-1.0])[0] != val(spark, "Log", [-1.0])[0] and val(spark, "Fract", [-0.25]) == [0.75]
    assert val(spark, "SmoothStep", [0.0], [1.0], [0.5]) == [0.5] and val(spark, "FMix", [0.0], [10.0], [0.25]) == [2.5] and val(spark, "FClamp", [5.0], [0.0], [1.0]) == [1.0]
    assert val(spark, "CompositeConstruct", [1.0, 2.0], [3.0, 4.0], [5.0]) == [1.0, 2.0, 3.0, 4.0]
    assert val(spark, "Select", [1], [1.0, 2.0], [3.0, 4.0]) == [1.0, 2.0] and val(spark, "Normalize", [3.0, 4.0]) == pytest.approx([0.6, 0.8])


def test_numeric(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1)], "v array<double>, t int")
    r = df.select(numeric.argmax(F.col("v")).alias("a"), numeric.softmax(F.col("v")).alias("s"), numeric.cross_entropy(F.col("v"), F.col("t")).alias("c"), numeric.cross_entropy(F.col("v"), F.lit(-1)).alias("n"), numeric.dequantise_int4(F.lit(0x7F), F.lit(0.5)).alias("q")).first()
    assert r.a == 1 and sum(r.s) == pytest.approx(1) and r.n is None and r.c == pytest.approx(0.7586, abs=1e-3)
    assert r.q == [-0.5, 3.5, 0, 0, 0, 0, 0, 0]
    assert numeric.dora_trainable(4096, 4096, 16) / (4096 * 4096) < 0.02
    base = spark.createDataFrame([(i, j, float(i + j + 1)) for i in range(3) for j in range(2)], "i long, j long, v double")
    m = numeric.column_norms(base).withColumnRenamed("norm", "m")
    zero = base.where("false")
    got = {(r.i, r.j): r.v for r in numeric.dora_weight(base, zero, zero, m).collect()}
    assert got == pytest.approx({(i, j): float(i + j + 1) for i in range(3) for j in range(2)}, abs=1e-5)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"T","description":"D","tags":"[\'x\']","image":"I","buffer_a":"A"}\nnot json\n{"id":"2"}\n')
    r = corpora.many_fields(spark, str(tmp_path / "a.jsonl"), "s").collect()
    assert [(x.id, x.name, x.tags, x.code) for x in r] == [("1", "T", ["x"], "I\n\nA")]
    (tmp_path / "c.jsonl").write_text('{"messages":[{"role":"user","content":"make it"},{"role":"assistant","content":"<think>no</think>ok ```glsl\\n// ID: abc\\n// Title: Nice one\\nvoid main(){}\\n```"}]}\n')
    r = corpora.chat_lines(spark, str(tmp_path / "c.jsonl"), "s").first()
    assert (r.id, r.name, r.desc, r.code.splitlines()[-1]) == ("abc", "Nice one", "make it", "void main(){}")
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "g" / "x.y.frag").write_text("code here")
    r = corpora.text_files(spark, str(tmp_path / "f"), "s", "*.frag").first()
    assert (r.id, r.code) == ("x", "code here")
    long = "void main() { gl_FragColor = vec4(1.0); }" * 3
    spark.createDataFrame([(long, "p/q/a.b.glsl"), ("short", "x"), (long + "UNITY_", "y")], "content string, max_stars_repo_path string").write.parquet(str(tmp_path / "p"))
    assert [x.name for x in corpora.code_parquet(spark, str(tmp_path / "p"), "glsl").collect()] == ["a.b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 01:30:00")], "id int, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_table(spark, str(tmp_path / "in"), rows.schema, 1)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert sorted(r.k for r in run(streams.first_occurrences(stream, "k", "ts", "1 day"), "firsts").collect()) == ["a", "b"]
    got = run(streams.tumbling_counts(stream, "ts", "1 hour", "1 hour", "k"), "counts", "complete").collect()
    assert sorted((r.k, r.n) for r in got) == [("a", 2), ("b", 1)]
    lanes = stream.selectExpr("1 as site", "cast(id as bigint) as lane", "cast(id as bigint) as bits", "true as active")
    assert [(r.warp, r.n_active, r.most) for r in run(streams.warp_counts(lanes), "warps", "complete").collect()] == [(0, 3, 2)]
