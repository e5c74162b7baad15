import pytest

from lanewise.llm import sharding as s


def check(spark, rows, shards, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = s.shard(docs, shards, **options).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got) == sorted((d is not None, d or 0, t or "") for d, t in rows)
    sizes, by = [0] * shards, {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 8
        sizes[r.shard] += r["size"]
        by.setdefault(r.shard, []).append((r.slot, r.doc_id is not None, r.doc_id or 0))
    for own in by.values():
        assert [x[0] for x in sorted(own)] == list(range(len(own)))
    order = [(d is not None, d) for k in sorted(by) for _, *d in sorted(by[k]) for d in [tuple(d)]]
    assert order == sorted(order)
    return sizes


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
@pytest.mark.parametrize("probes", [2, 16, 4096])
def test_even(spark, shards, probes):
    rows = [(k * 7919 % 10007 - 5000, "é" * (k % 13)) for k in range(300)]
    sizes = check(spark, rows, shards, probes=probes)
    assert max(sizes) - min(sizes) <= 2 * (8 + 26)


def test_exact_definition(spark):
    rows = [(k, "x" * (k * k % 50)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total, below = sum(len(t) + 8 for _, t in rows), 0
    want = {}
    for d, t in rows:
        want[d] = below * 24 // total
        below += len(t) + 8
    assert {r.doc_id: r.shard for r in s.shard(docs, 24, probes=8).collect()} == want


def test_hot_key_and_repeated_rows(spark):
    rows = [(5, f"text {k}") for k in range(100)] + [(7, "same")] * 100 + [(None, None)] * 20 + [(k, "t") for k in range(10)] + [(2**62, "far"), (-(2**62), "far")]
    sizes = check(spark, rows, 8, probes=64)
    assert max(sizes) - min(sizes) <= 40


def test_tolerance_and_clashing_columns(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', int(id % 9)) as text", "1 as Shard", "2 as k1", "3 as slot")
    got = s.shard(docs, 4, tolerance=0.2, probes=4)
    assert got.columns == ["doc_id", "text", "k1", "size", "shard", "slot"]
    sizes = [r[1] for r in got.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 0.45 * sum(sizes) / 4


def test_empty(spark):
    assert s.shard(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0


def test_own_columns_stay_under_other_names(spark):
    docs = spark.createDataFrame([(k, "x" * k, 100 + k, 200 + k, 300 + k) for k in range(50)], "doc_id long, text string, size int, shard int, slot int")
    got = s.shard(docs, 4, out=("bytes", "part", "place"))
    assert got.columns == [*docs.columns, "bytes", "part", "place"]
    assert all((r["size"], r.shard, r.slot, r.bytes) == (100 + r.doc_id, 200 + r.doc_id, 300 + r.doc_id, r.doc_id + 8) for r in got.collect())
    assert {(r.part, r.place) for r in got.collect()} == {(r.shard, r.slot) for r in s.shard(docs, 4).collect()}


def test_text_and_other_keys(spark):
    keys = ["", "a", "ab", "b", "é", "漢字", "zzzzzzzzzz", None, "a\0"] * 9
    docs = spark.createDataFrame([(k, f"t{n}", float(n % 5)) for n, k in enumerate(keys)], "name string, text string, x double")
    got = s.shard(docs, 3, key="name", probes=8).collect()
    assert len(got) == len(keys)
    order = [(r.name or "").encode()[:8].ljust(8, b"\0") for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(3)]
    assert max(sizes) - min(sizes) <= 22
    assert s.shard(docs, 3, key="x").count() == len(keys)
