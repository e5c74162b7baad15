import numpy as np
import pyarrow.dataset as ds
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import packing as p


def plain(sizes, length):
    rows, room = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[k]]
        if not fits:
            rows.append([])
            room.append(length)
            fits = [len(rows) - 1]
        best = min(fits, key=lambda r: room[r])
        rows[best].append(k)
        room[best] -= sizes[k]
    return rows, room


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 33))
def test_is_best_fit_decreasing(sizes, length):
    rows = p.best_fit_decreasing(sizes, length)
    assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
    rooms = sorted(length - sum(sizes[k] for k in r) for r in rows)
    assert rooms == sorted(plain(sizes, length)[1]) and (not rooms or rooms[0] >= 0)


def test_lossless(spark):
    texts = ["hello world " * 40, "", None, "a", "é漢🙂 " * 99, "same", "same"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, pack_id int").repartition(2)
    for block in (50, 1_000_000):
        found = {}
        for r in p.pack(docs, length=64, block_tokens=block).collect():
            ids, pos, cu = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4"), r.cu_seqlens
            assert len(ids) == len(pos) == 64 and cu[0] == 0 and cu[-1] <= 64
            for d, c, a, b in zip(r.doc_ids, r.chunks, cu[:-1], cu[1:], strict=True):
                assert pos[a:b].tolist() == list(range(b - a))
                found[d, c] = ids[a:b].tolist()

        enc = p._tokenizer(p.vocabulary(spark))
        for k, t in [*enumerate(texts), (None, "no id")]:
            own = [x for (d, c), v in sorted(found.items(), key=lambda y: (str(y[0][0]), y[0][1])) if d == k for x in v]
            assert own == enc.encode_ordinary(t or "")
    assert p.pack(docs.limit(0)).count() == 0


def test_files_and_back(spark, tmp_path):
    texts = ["hello world " * 40, "", None, "a", "é漢🙂 " * 999, "tail"]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / "packed")
    p.write_packed(docs, path, length=64)
    enc = p._tokenizer(p.vocabulary(spark))
    want = {k: np.array(enc.encode_ordinary(t), "<u4").tobytes() for k, t in enumerate(texts) if t}
    assert {r.doc_id: bytes(r.ids) for r in p.unpacked(p.read_packed(spark, path)).collect()} == want
    tokens = 0
    for ids, positions, cuts in p.matrices(ds.dataset(path).to_batches(batch_size=5)):
        assert ids.shape == positions.shape == (len(cuts), 64)
        for own, at, cut in zip(ids, positions, cuts, strict=True):
            assert cut[0] == 0 and (at[cut[:-1]] == 0).all() and (own[cut[-1] :] == p.PAD).all()
            tokens += int(cut[-1])
    assert 4 * tokens == sum(map(len, want.values()))


def test_fill_over_many_small_partitions(spark):
    """Each partition leaves part-filled rows of its own: the fill that the README states."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word and ', cast(20 + id * 7919 % 900 as int)) as text")
    fill = {}
    for parts in (2, 200):
        rows = p.pack(docs.repartition(parts)).select(F.element_at("cu_seqlens", -1).alias("n")).collect()
        fill[parts] = sum(r.n for r in rows) / (len(rows) * p.LENGTH)
    assert fill[2] > 0.99 and fill[200] > 0.85  # measured: 0.997 and 0.879
