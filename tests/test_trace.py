import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import values as v
from lanewise.operators import trace as tr
from lanewise.sources import arrays, generators, spirv, store

N = 1 << 20
#: Published figures: bits a value, residual and order-0 entropy.
GOLDEN = {
    "constant": (1.218803406, 0, 0),
    "quad_coherent": (7.187919617, 5.701016313, 5.999855113),
    "warp_gradient": (6.631248474, 5.042928164, 16.53889797),
    "float_smooth": (25.09612274, 19.43550909, 19.98079585),
    "random32": (32.03130341, 19.53103065, 19.99971771),
    "gradient_div50": (9.572458107, 4.991080045, 16.53889797),
    "gradient_div10": (25.9377793, 4.243571445, 16.53889797),
}


def column(spark, name):
    g = generators
    return {
        "constant": lambda: g.constant(spark, N, 42),
        "quad_coherent": lambda: g.quad_coherent(spark, N),
        "warp_gradient": lambda: g.warp_gradient(spark, N),
        "float_smooth": lambda: g.float_smooth(spark, N),
        "random32": lambda: g.random32(spark, N, 12345),
        "gradient_div50": lambda: g.with_divergence(g.warp_gradient(spark, N), 0.5, 2),
        "gradient_div10": lambda: g.with_divergence(g.warp_gradient(spark, N), 0.1, 2),
    }[name]()


@pytest.mark.parametrize("name", GOLDEN)
def test_published_codec_figures(spark, name):
    kind, c = "F32" if name == "float_smooth" else "U32", column(spark, name)
    per = tr.codec_sizes(c, kind, masked="div" in name).first().bits_per_value
    residual = tr.entropy(tr.residuals(c, kind), "residual", ["site"]).first().entropy_bits
    order0 = tr.entropy(c, "bits", ["site"]).first().entropy_bits
    assert (per, residual, order0) == pytest.approx(GOLDEN[name], rel=2e-9, abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 1000])
@pytest.mark.parametrize("kind", store.KINDS)
@pytest.mark.parametrize("masked", [None, 0.0, 0.4, 1.0])
def test_blobs_round_trip(n, kind, masked):
    r = np.random.default_rng(n)
    bits = r.integers(0, 1 << r.integers(1, 33), n).astype(np.uint64)
    active = None if masked is None else r.random(n) < masked
    for warp in (0, 1, 32):
        blob = store.encode(bits, active, kind, warp)
        back, mask, k, w = store.decode(blob)
        assert k == kind and w == warp and (mask is None) == (active is None)
        assert back.tolist() == (bits if active is None else np.where(active, bits, 0)).tolist()


def test_blob_size_is_the_closed_form(spark):
    c = generators.with_divergence(generators.warp_gradient(spark, 1000), 0.4, 3)
    blob = store.encode_sites(c, masked=True).first()
    assert len(blob.blob) == tr.codec_sizes(c, masked=True).first().n_bytes
    back = store.decode_sites(spark.createDataFrame([blob])).orderBy("lane").collect()
    assert [(r.lane, r.bits if r.active else 0, r.active) for r in back] == [(r.lane, r.bits if r.active else 0, r.active) for r in c.orderBy("lane").collect()]


def test_indexed_files(spark, tmp_path):
    columns = [(site, n, store.encode(np.arange(n))) for site, n in ((10, 5), (20, 0), (30, 7))]
    (tmp_path / "a.otr").write_bytes(store.pack_file(columns))
    (tmp_path / "b.otr").write_bytes(store.pack_file([]))
    read = store.read_files(spark, str(tmp_path))
    assert [(r.site, r.n) for r in read.orderBy("position").collect()] == [(10, 5), (20, 0), (30, 7)]
    assert bytes(store.column_by_site(read, 30).first().blob) == columns[2][2]
    assert store.column_by_site(read, 999).count() == 0
    with pytest.raises(ValueError):
        store.unpack_file(store.pack_file(columns)[:-1])


def test_generator_jumps():
    own = generators.draws(2024, 0, 500)
    assert generators.draws(2024, 123, 77).tolist() == own[123:200].tolist()
    state, want = 2024, []
    for _ in range(10):
        state = (state * generators.MUL + generators.ADD) & generators.MASK
        want.append(state >> 32)
    assert own[:10].tolist() == want


def ulp(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a float, b float")
    return df.select(v.ulp_distance(v.float_bits(F.col("a")), v.float_bits(F.col("b"))).alias("u")).first().u


def test_ulp_steps(spark):
    one = np.float32(1)
    up = np.nextafter(one, np.float32(2))
    assert [ulp(spark, 1.0, float(x)) for x in (one, up, np.nextafter(up, np.float32(2)))] == [0, 1, 2]
    assert ulp(spark, 0.0, -0.0) == 0 and ulp(spark, -1e-45, 1e-45) == 3 and ulp(spark, float("nan"), float("nan")) == 0


def f32(spark, values, active=None):
    rows = [(k, int(np.float32(x).view(np.uint32)), True if active is None else active[k]) for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "lane long, bits long, active boolean")


def test_numeric_diff(spark):
    a = np.arange(64, dtype=np.float32) * np.float32(0.1)
    b = a.copy()
    b[5] = (b[5:6].view(np.uint32) + 3).view(np.float32)[0]
    r = tr.numeric_diff(f32(spark, a), f32(spark, b)).first()
    assert (r.n, r.mismatches, r.max_ulp, r.first_mismatch) == (64, 1, 3, 5) and r.max_rel > 0
    r = tr.numeric_diff(f32(spark, a), f32(spark, a)).first()
    assert (r.mismatches, r.max_ulp, r.mean_ulp, r.first_mismatch) == (0, 0, 0.0, -1)
    assert tr.numeric_diff(f32(spark, a), f32(spark, b, [k != 5 for k in range(64)])).first().mismatches == 0


@pytest.mark.parametrize("classes, want", [([k % 32 // 16 for k in range(64)], 0.5), (list(range(32)), 1 - 1 / 32), ([7] * 64, 0.0), ([], 0.0)])
def test_divergence(spark, classes, want):
    df = spark.createDataFrame([(k, c, True) for k, c in enumerate(classes)], "lane long, class int, active boolean")
    assert tr.divergence(df).first().divergence == want


def test_timeline(spark):
    trace = spark.createDataFrame([(s, lane, 10 * s + lane, (s, lane) != (2, 1)) for s in (3, 1, 2) for lane in (0, 1)] + [(99, 0, 1, True)], "site int, lane long, bits long, active boolean")
    sites = spark.createDataFrame([(s, f"op{s}", s) for s in (1, 2, 3, 4)], "site int, def_op string, line int")
    steps = tr.timeline(trace, sites)
    assert [(r.lane, r.step, r.site, r.delta) for r in steps.orderBy("lane", "step").collect()] == [(0, 0, 1, None), (0, 1, 2, 10), (0, 2, 3, 10), (1, 0, 1, None), (1, 1, 3, 20)]
    assert [r.site for r in tr.seek(steps, 9).orderBy("lane").collect()] == [3, 3]
    assert [r.site for r in tr.seek(steps, -1).orderBy("lane").collect()] == [1, 1]


def test_arrays_and_images(spark, tmp_path):
    values = np.arange(1000) * 7 % 258
    (tmp_path / "t.npy").write_bytes(arrays.npy_bytes(values))
    assert np.load(tmp_path / "t.npy").tolist() == values.tolist()
    read = arrays.read_npy(spark, str(tmp_path / "t.npy"))
    assert [r.token for r in read.orderBy("pos").collect()] == values.tolist()
    made = arrays.npy_shards(read.withColumn("shard", F.col("pos") % 2), "shard").where("shard = 1").first()
    assert arrays.npy_values(bytes(made.content)).tolist() == values[1::2].tolist()
    pixels = spark.createDataFrame([(1, 0, 0, -1.0, 0.5, 2.0), (1, 1, 0, 0.0, 1.0, 0.25)], "img long, x int, y int, r double, g double, b double")
    assert bytes(arrays.ppm_images(pixels).first().content) == b"P6\n2 1\n255\n" + bytes([0, 128, 255, 0, 255, 64])
    (tmp_path / "run.conf").write_text("lr = 0.1  # rate\nsteps 80\n\nlr = 0.2\n")
    got = {r.key: r.value for r in arrays.read_config(spark, str(tmp_path / "run.conf"), {"lr": "1", "seed": "7"}).collect()}
    assert got == {"lr": "0.2", "steps": "80", "seed": "7"}


def test_spirv_round_trip(spark, tmp_path):
    rows = [("Float", None, 1, [32]), ("Constant", 1, 2, [0x3F800000]), ("FunctionBegin", 1, 3, [0, 4]), ("Label", None, 5, []), ("FAdd", 1, 6, [2, 2]), ("TraceTap", None, None, [6]), ("FMul", 1, 7, [6, 2]), ("Branch", None, None, [8]), ("Label", None, 8, []), ("Return", None, None, []), ("FunctionEnd", None, None, [])]
    (tmp_path / "m.spv").write_bytes(spirv.emit(rows, 9) + (2 << 16 | 17).to_bytes(4, "little") + b"\1\0\0\0")
    read = spirv.read_modules(spark, str(tmp_path))
    got = [(r.op, r.func, r.block, r.type, r.result, r.operands) for r in read.orderBy("inst").collect()]
    assert got[2:6] == [("FAdd", 3, 5, 1, 6, [2, 2]), ("FMul", 3, 5, 1, 7, [6, 2]), ("Branch", 3, 5, None, None, [8]), ("Return", 3, 8, None, None, [])]
    d = spirv.diagnostics(read).first()
    assert (d.handled, d.skipped, d.unhandled) == (6, 1, ["op#17"])
    with pytest.raises(ValueError):
        list(spirv.lift("x", b"abc"))
