import hashlib
import json
import math
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise import __main__ as cli
from lanewise.functions import values
from lanewise.operators import corpus, graph, numeric, prompts, timings, trace
from lanewise.operators import tokens as tk
from lanewise.sources import corpora, store


def plan(df):
    return df._jdf.queryExecution().toString()


def test_byte_tokens_of_a_long_text(spark):
    text = "añb漢" * 200_000  # 1.6 MB
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    got = {(r.a, r.b): r.n for r in tk.bigrams(docs).collect()}
    ids = [256, *text.encode(), 257]
    want = {}
    for pair in zip(ids, ids[1:], strict=False):
        want[pair] = want.get(pair, 0) + 1
    want[256, 257] = 1
    assert got == want
    assert docs.select(tk.detokenize(tk.framed(F.col("text"))).alias("t")).where(F.col("t") == F.lit(text)).count() == 1
    assert time.perf_counter() - began < 60


def test_numbers_by_pieces(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(50), k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    out = trace.numbered(df.where("g is not null"), "g", ["x", "y"], "at")
    want = df.where("g is not null").withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("x", "y")).cast("long") - 1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "SinglePartition" not in plan(out)


def test_pieces_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(trace, "PIECE", 100)
    sizes, cut = [], trace.durable
    monkeypatch.setattr(trace, "durable", lambda df: sizes.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]) or cut(df))
    rows = spark.range(5000).selectExpr("id % 7 as g", "id * 7919 % 5000 as x", "'dropped' as y")
    own, all_ = trace.numbered(rows, "g", ["x"], "at", keep=["x"]), trace.numbered(rows, None, ["x"], "at", keep=["g", "x"])
    assert own.columns == ["g", "x", "at"] and max(sizes) < 500  # 1,250 by the session's four partitions
    assert "row_number" not in plan(own) and "SinglePartition" not in plan(all_)
    want = rows.select("g", "x", (F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1).cast("long").alias("at"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
    assert {r.x: r.at for r in all_.collect()} == {k: k for k in range(5000)}


def test_sites_of_many_functions_are_numbered_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(trace, "PIECE", 20)
    shape = "func string, block long, pos int, inst long, op string, type long, result long, imm0 long, imm1 long, line int"
    insts = spark.createDataFrame([(f"f{k % 40}", k % 3, k, k, "FAdd", 2, k, None, None, 0) for k in range(300)], shape)
    types = spark.createDataFrame([(2, "Float", None)], "type long, kind string, elem long")
    sites = graph.tap_sites(insts, types)
    assert "SinglePartition" not in plan(sites)
    want = sorted((r.func, r.block, r.pos, r.inst) for r in insts.collect())
    assert [r.inst for r in sites.orderBy("site_id").collect()] == [w[3] for w in want]
    assert [r.site_id for r in sites.orderBy("site_id").collect()] == list(range(300))


def test_taps_are_numbered_by_pieces_once(spark, monkeypatch):
    monkeypatch.setattr(trace, "PIECE", 20)
    calls = []
    monkeypatch.setattr(graph, "numbered", lambda *a: calls.append(a[0].columns) or trace.numbered(*a))
    shape = "func string, block long, pos int, inst long, op string, type long, result long, imm0 long, imm1 long, line int"
    insts = spark.createDataFrame([(f"f{k % 40}", k % 3, k, k, "FAdd", 2, k, None, None, 0) for k in range(300)], shape)
    types, none = spark.createDataFrame([(2, "Float", None)], "type long, kind string, elem long"), spark.createDataFrame([], "inst long, pos int, value long")
    tapped, sites = graph.insert_taps(insts, types, none)
    assert len(calls) == 1 and {"block", "pos"} <= set(calls[0]) and tapped.count() == 600 and sites.count() == 300
    by_inst = {r.inst: r.site_id for r in sites.collect()}
    rows = sorted((r.func, r.block, r.pos, r.op, r.inst, r.imm0) for r in tapped.collect())
    assert all(b[3] == "TraceTap" and b[5] == by_inst[a[4]] for a, b in zip(rows[::2], rows[1::2], strict=True))


def test_verify_looks_values_up_once(spark):
    insts = spark.createDataFrame([("f", 0, 0, 1, "FAdd", 2, 10), ("f", 0, 1, 2, "Return", None, None), ("f", 1, 0, 3, "Kill", 2, 11), ("f", 1, 1, 4, "FAdd", 2, 12), ("f", 2, 0, 5, "Return", 3, 13)], "func string, block long, pos int, inst long, op string, type long, result long")
    values = spark.createDataFrame([(10, "InstResult", 1, 2), (12, "Param", 9, 7), (13, None, 5, 3), (77, "Param", 1, 1), (77, "Param", 2, 2)], "value long, kind string, inst long, type long")
    operands = spark.createDataFrame([(1, 0, 77), (2, 0, 78), (3, 0, None), (4, 0, 10), (5, 0, 13)], "inst long, pos int, value long")
    funcs = spark.createDataFrame([("f",), ("g",)], "func string")
    blocks = spark.createDataFrame([("f", 0), ("f", 1), ("f", 2), ("f", 3)], "func string, block long")
    out = graph.verify(funcs, blocks, insts, operands, values)
    assert sorted(map(tuple, out.collect())) == [("bad_operand", "2"), ("bad_operand", "3"), ("bad_result", "3"), ("bad_result", "5"), ("early_terminator", "3"), ("empty_block", "3"), ("no_blocks", "g"), ("no_terminator", "4"), ("type_mismatch", "4"), ("unlinked_result", "4")]
    assert plan(out).split("== Physical Plan ==")[1].split("Initial Plan")[-1].count("Join ") <= 3


def test_bigrams_in_stretches_make_no_row_a_byte(spark, monkeypatch):
    monkeypatch.setattr(tk, "STRETCH", 3)
    r = random.Random(2)
    texts = ["".join(r.choice("abñ漢") for _ in range(r.choice([0, 0, 1, 2, 9]))) for _ in range(60)] + [None]
    want = {}
    for t in texts[:-1]:
        own = [256, *t.encode(), 257]
        for p in zip(own, own[1:], strict=False):
            want[p] = want.get(p, 0) + 1
    out = tk.bigrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {(x.a, x.b): x.n for x in out.collect()} == want and "explode" not in plan(out)
    assert tk.bigrams(spark.createDataFrame([], "text string")).count() == 0


def test_dora_deals_no_rows_by_few_keys(spark):
    cells = lambda rows: spark.createDataFrame(rows, "i long, j long, v double")
    base, b, a = cells([(i, j, 1.0 + i + j) for i in range(50) for j in range(3)]), cells([(i, 0, i % 3 * 0.1) for i in range(50)]), cells([(0, j, j * 0.2) for j in range(3)])
    out = numeric.dora_weight(base, b, a, numeric.column_norms(base).withColumnRenamed("norm", "m"))
    moved = {(i, j): 1.0 + i + j + i % 3 * 0.1 * j * 0.2 for i in range(50) for j in range(3)}
    norm = lambda m, j: math.sqrt(sum(v * v for (_, k), v in m.items() if k == j))
    scale = [norm({(i, j): 1.0 + i + j for i, j in moved}, j) / norm(moved, j) for j in range(3)]
    got = {(r.i, r.j): r.v for r in out.collect()}
    assert got.keys() == moved.keys() and all(abs(v - moved[k] * scale[k[1]]) < 1e-9 for k, v in got.items())
    assert "SortMergeJoin" not in plan(out)


def test_split_without_a_large_top_n(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW", 3)
    rows = spark.range(3000).selectExpr("id as seq", "cast(id % 500 as string) as id", "'n' as name")
    key = lambda s: hashlib.sha1(f"{s % 500}n".encode()).hexdigest()
    for fraction in (0.0, 0.02, 0.5, 1.0):
        got = {r.seq for r in corpus.deterministic_split(rows, fraction).where("is_val").collect()}
        assert got == set(sorted(range(3000), key=lambda s: (key(s), s))[: int(3000 * fraction)])


def test_warps_of_a_site_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trace, "WARPS", 3)
    rows = [(0, lane, 7, lane % 3 == 0) for lane in (0, 5, 40, 300)] + [(1, 31, 9, True)]
    cost = trace.warp_costs(spark.createDataFrame(rows, "site int, lane long, bits long, active boolean")).collect()
    assert sorted((r.site, r.warp) for r in cost) == [(0, w) for w in range(10)] + [(1, 0)]
    assert {(r.site, r.warp): r.n_active for r in cost if r.n_active} == {(0, 0): 1, (0, 9): 1, (1, 0): 1}


def test_passes_and_records(spark, tmp_path):
    passes = lambda *p: [{"type": t, "code": c} for t, c in p]
    long = "void mainImage() { vec4 colour = vec4(1.0); }"
    files = {
        "a.json": {"info": {"name": " Fire\nball ", "description": "first\r\nsecond", "tags": ["x", "", "y"], "likes": 5}, "renderpass": passes(("image", long), ("common", "// c"), ("buffer", " \n"), ("strange", "// s"))},
        "b.json": {"info": {"name": "copy", "likes": 9}, "renderpass": passes(("common", "// c"), ("strange", "// s"), ("image", long))},
        "c.json": {"info": {"name": "few", "likes": 1}, "renderpass": passes(("image", long + "1"))},
        "d.json": {"info": {"name": "", "likes": 9}, "renderpass": passes(("image", long + "2"))},
        "e.json": {"info": {"name": "short", "likes": 9}, "renderpass": passes(("image", "x"))},
        "f.json": {"info": {"name": "known", "likes": 9}, "renderpass": passes(("image", long + "3"))},
        "g.json": None,
    }
    folder = tmp_path / "api"
    folder.mkdir()
    for name, what in files.items():
        (folder / name).write_text("not json" if what is None else json.dumps(what))
    known = spark.createDataFrame([(long + "3",)], "text string")
    got = {r.file: r for r in corpora.api_records(spark, str(folder), known, min_likes=2).collect()}
    code = f"// c\n\n// s\n\n{long}"
    assert set(got) == {"a.json"} and got["a.json"].code == code and got["a.json"].hash == hashlib.sha1(code.encode()).hexdigest()
    assert got["a.json"].record == f"// Shader: Fire ball\n// first\n// tags: x, y\n{code}"
    assert set(r.file for r in corpora.api_records(spark, str(folder)).collect()) == {"a.json", "c.json", "f.json"}


def test_lines_end_where_python_ends_them(spark):
    raw = "Sure\r\nhere\x0bfloat x;\r\ny\x85z"
    one = spark.createDataFrame([(raw,)], "raw string")
    assert one.select(corpus.extract_code(F.col("raw"))).first()[0] == "\n".join(raw.splitlines()[2:])
    record, _ = corpus.record_of(F.lit("n"), F.lit("a\rb"), F.array(), F.lit("c"))
    assert one.select(record).first()[0] == "// Shader: n\n// a\nc\n"


def test_bpe_encoding(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("aabcé") for _ in range(r.randint(1, 7))) for _ in range(12)) for _ in range(15)] + ["", None, "a  b\n\n c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    merges = tk.train_bpe(docs, 25)
    names = [f"{b:02X}" for b in range(256)] + [a + b for a, b, _ in merges]
    table = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(merges)], "rank int, a string, b string")
    got = {x.doc_id: x.tokens for x in tk.encode_bpe(docs, table).collect()}
    assert got.keys() == set(range(len(texts)))
    cut = {x.doc_id: x.p for x in docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tk.PRETOKEN), F.lit(0)).alias("p")).collect()}
    for k, text in enumerate(texts):
        want = []
        for piece in cut[k]:
            word = [f"{b:02X}" for b in piece.encode()]
            for a, b, _ in merges:  # each merge in turn, over the whole word
                at = 0
                while at < len(word) - 1:
                    if word[at] == a and word[at + 1] == b:
                        word[at : at + 2] = [a + b]
                    at += 1
            want += word
        assert [names[t] for t in got[k]] == want
        assert bytes.fromhex("".join(names[t] for t in got[k])).decode() == (text or "")


def test_byte_level_alphabet(spark):
    symbols = tk.printable_bytes()
    assert len(set(symbols)) == 256 and symbols[32] == "Ġ" and symbols[10] == "Ċ" and symbols[65] == "A"
    text = "".join(map(chr, range(1, 0x300))) + "漢🙂"
    got = spark.createDataFrame([(text,)], "t string").select(tk.spelled_bytes(F.col("t"))).first()[0]
    assert got == "".join(symbols[b] for b in text.encode())


def test_samples_and_repeats(spark):
    rows = spark.range(20).withColumnRenamed("id", "k")
    some = [r.k for r in prompts.sampled(rows, 5, 7, "k").collect()]
    assert len(set(some)) == 5 and sorted(some) == sorted(r.k for r in prompts.sampled(rows.repartition(6), 5, 7, "k").collect())
    many = [r.k for r in prompts.sampled(rows, 47, 7, "k").collect()]
    assert len(many) == 47 and {many.count(k) for k in range(20)} == {2, 3}
    assert prompts.sampled(rows.limit(0), 5, 7, "k").count() == 0


def test_statistics_of_samples(spark, tmp_path):
    rows = spark.createDataFrame([("a", 4.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("b", None)], "name string, ns double")
    stats = timings.sample_stats(rows, "name")
    assert sorted(map(tuple, stats.collect())) == [("a", 1.0, 4.0, 4.0, 9.0, 4), ("b", 5.0, 5.0, 5.0, 5.0, 1)]
    timings.write_records(timings.records(stats, "suite", "name"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).where("metric = 'median' and name = 'a'").first().value == "4.0"
    (tmp_path / "m.json").write_text('{"n": 20, "rate": 0.9, "name": "x"}')
    assert sorted(map(tuple, corpora.read_metrics(spark, str(tmp_path / "m.json")).collect())) == [("m.json", "n", 20.0), ("m.json", "rate", 0.9)]


def test_taps_are_inserted_once(spark):
    shape = "func string, block long, pos int, inst long, op string, type long, result long, imm0 long, imm1 long, line int"
    insts = spark.createDataFrame([("f", 0, 0, 0, "FAdd", 2, 10, None, None, 3), ("f", 0, 1, 1, "FMul", 2, 11, None, None, 4), ("f", 0, 2, 2, "Return", None, None, None, None, 5)], shape)
    types = spark.createDataFrame([(2, "Float", None)], "type long, kind string, elem long")
    none = spark.createDataFrame([], "inst long, pos int, value long")
    once, sites = graph.insert_taps(insts, types, none, F.col("op") == "FAdd")
    assert [(r.pos, r.op, r.imm0) for r in once.orderBy("pos").collect()] == [(0, "FAdd", None), (1, "TraceTap", 0), (2, "FMul", None), (3, "Return", None)]
    tapped = once.where("op = 'TraceTap'").select("inst", F.lit(0).alias("pos")).crossJoin(sites.select("value"))
    twice, more = graph.insert_taps(once, types, tapped)
    assert [(r.pos, r.op) for r in twice.orderBy("pos").collect()] == [(0, "FAdd"), (1, "TraceTap"), (2, "FMul"), (3, "TraceTap"), (4, "Return")]
    assert [r.value for r in more.collect()] == [11]


def test_labels_become_blocks(spark):
    shape = "func long, block long, pos int, op string, imm0 long, imm1 long"
    insts = spark.createDataFrame([(1, 0, 0, "BranchConditional", 50, 51), (1, 1, 0, "Branch", 99, 50), (1, 2, 0, "Return", 50, None)], shape)
    labels = spark.createDataFrame([(1, 50, 1), (1, 51, 2)], "func long, label long, block long")
    assert sorted(map(tuple, graph.resolved_labels(insts, labels).collect()), key=str) == [(1, 0, 0, "BranchConditional", 1, 2), (1, 1, 0, "Branch", 99, 50), (1, 2, 0, "Return", 50, None)]


def test_tiny_model_learns(spark):
    text = b"abcabcabd" * 12
    tokens = spark.createDataFrame(list(enumerate(text)) + [(1000, 999)], "pos long, token int")
    loss = [r.loss for r in numeric.tiny_model(tokens, 128, 8, 4, 0.5).orderBy("epoch").collect()]
    assert len(loss) == 4 and loss == sorted(loss, reverse=True) and abs(loss[0]) < math.log(128) and loss[-1] < 1.0
    assert numeric.tiny_model(tokens.limit(0), 4, 2, 1, 0.1).count() == 0 and numeric.tiny_model(tokens.limit(1), 4, 2, 1, 0.1).first().loss == 0


def test_columns_by_index(spark):
    columns = spark.createDataFrame([("p", k, 5 + k, 1, bytearray(b"x")) for k in range(3)], "path string, position int, site long, n long, blob binary")
    assert [r.site for r in store.column_by_index(columns, 1).collect()] == [6] and store.column_by_index(columns, 3).count() == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "a", "compiled": true, "executed": true, "visual_match": 0.5}\n{"id": "b"}\n')
    cli.main(["reward", str(tmp_path / "c.json"), str(tmp_path / "r")], spark)
    assert {(r.id, r.total, r.verdict) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("a", 4.5, "runs"), ("b", 0.0, "broken")}
    (tmp_path / "p.json").write_text("".join(json.dumps({"id": i, "rgb": [x, x, x]}) + "\n" for i, xs in (("flat", (0.5, 0.5)), ("busy", (0.0, 1.0))) for x in xs))
    cli.main(["probe", str(tmp_path / "p.json"), str(tmp_path / "s")], spark)
    got = {r.id: (r.total, r.r_visual) for r in spark.read.json(str(tmp_path / "s")).collect()}
    assert got["flat"] == (3.5, 0.0) and got["busy"][1] > 1.9
    (tmp_path / "src").mkdir()
    for k in range(6):
        (tmp_path / "src" / f"s{k}.frag").write_text("void mainImage(out vec4 c) { c = vec4(" + "0.1 + " * 10 + f"{k % 5}.0); }}")
    cli.main(["corpus", str(tmp_path / "src"), str(tmp_path / "out")], spark)
    stats = spark.read.json(str(tmp_path / "out/stats.json")).first()
    assert (stats.kept, stats.train, stats.val) == (5, 5, 0)


def test_wrapping_styles(spark):
    own = "void main () { gl_FragColor = vec4(1); }"
    df = spark.createDataFrame([(own,), ("#version 300\n" + own,), ("out vec4 o; " + own,), ("col = vec3(1);",), ("void mainImage() {}",)], "code string")
    ours = [r.w for r in df.select(prompts.wrapped(F.col("code")).alias("w")).collect()]
    theirs = [r.w for r in df.select(prompts.wrapped(F.col("code"), "label").alias("w")).collect()]
    assert ours[0] == prompts.VERSION + prompts.OUTPUT + own and ours[2] == "out vec4 o; " + own
    assert theirs[0] == prompts.VERSION + own and theirs[1] == "#version 300\n" + own
    assert ours[3] == theirs[3] and ours[3].endswith("col = vec3(1);" + prompts.CLOSE) and ours[4].endswith(prompts.CALL)


def test_fused_and_strict_products(spark):
    near = 1 + 2.0**-12
    row = spark.createDataFrame([(near, near, -(1 + 2.0**-11)), (3.0, 4.0, 5.0)], "a double, b double, c double")
    got = row.select(values.fused_multiply_add(F.col("a"), F.col("b"), F.col("c")).alias("f"), values.strict_multiply_add(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [(r.f, r.s) for r in got] == [(2.0**-24, 0.0), (17.0, 17.0)]
