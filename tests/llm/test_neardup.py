import random
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import neardup as d


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


SEQ = st.lists(st.integers(0, 5), max_size=40)


@settings(max_examples=500, deadline=None)
@given(SEQ, st.lists(st.tuples(st.integers(0, 40), st.sampled_from("idr"), st.integers(0, 9)), max_size=6))
def test_similarity_is_exact(a, edits):
    b = list(a)
    for at, what, x in edits:
        if what == "i":
            b.insert(at, x)
        elif at < len(b):
            b[at : at + 1] = [x] * (what == "r")
    assert d.similar(a, b) == (9 * lcs(a, b) >= 4 * (len(a) + len(b)))


@settings(max_examples=300, deadline=None)
@given(SEQ, SEQ)
def test_unrelated_similarity_is_exact(a, b):
    assert d.similar(a, b) == (9 * lcs(a, b) >= 4 * (len(a) + len(b)))


def test_words():
    assert d.words_of(" A\tb\x0bC\x1cd\xa0e ") == ["a", "b", "c\x1cd\xa0e"]
    assert d.words_of("A b\n\nC") == ["a", "b", "c"]
    assert d.words_of("") == []


def brute(rows):
    texts = sorted({t for _, t in rows if t is not None})
    seqs = [d.shingles(d.words_of(t)).tolist() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if seqs[i] and seqs[j] and 9 * lcs(seqs[i], seqs[j]) >= 4 * (len(seqs[i]) + len(seqs[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, t in rows:
        groups.setdefault(("null", i) if t is None else find(texts.index(t)), []).append(i)
    return sorted(sorted(g) for g in groups.values())


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    rows, n = [], 0
    for size in (3, 7, 12, 30, 60, 75, 90, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 40, size // 20):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(len(copy))] = word()
                rows.append((n, " ".join(copy)))
                n += 1
    shared = [word() for _ in range(40)]
    rows += [(n + k, " ".join([word() for _ in range(20)] + shared + [word() for _ in range(20)])) for k in range(40)]
    rows += [(n + 100, None), (n + 101, None), (n + 102, ""), (n + 103, ""), (n + 104, " \n"), (n + 105, "--")]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {}
    for r in d.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == brute(rows)
    assert all(k == min(g) for k, g in got.items())


@pytest.mark.parametrize("chunk", [2, 256])
def test_prefix_join_loses_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(d, "CHUNK", chunk)
    r = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(3000)}"
        if k % 7 == 0:
            del copy[: r.randint(1, 8)]
        rows.append((k, " ".join(copy)))
    # twins of edited copies: their partners share rare shingles only
    rows += [(100 + k, t + " tail") for k, t in rows[:20]] + [(200, "a b " * 90), (201, "a b " * 85 + "c")]
    got = {}
    for x in d.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.class_id, []).append(x.doc_id)
    assert sorted(sorted(g) for g in got.values()) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 2), max_size=60))
def test_frequent_shingles_align_alike(a, b):
    held, d.DENSE = d.DENSE, 3
    try:
        assert d.similar(a, b) == (9 * lcs(a, b) >= 4 * (len(a) + len(b)))
    finally:
        d.DENSE = held


@pytest.mark.parametrize("kinds", [10**9, 50])
def test_very_long_pair_in_bounded_memory(kinds):
    r = random.Random(12)
    a = [r.randrange(kinds) for _ in range(200_000)]
    b = list(a)
    for at in sorted(r.sample(range(len(b)), 10_000), reverse=True):
        b[at : at + 1] = [] if at % 3 == 0 else [-1 - at]
    began = time.perf_counter()
    tracemalloc.start()
    assert d.similar(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200_000_000 and time.perf_counter() - began < 240


def test_a_component_never_meets_itself(spark):
    """A group of 20,000 with three shingles in common and an outlier that has two of them."""
    n = 20_000
    group = spark.range(n).selectExpr("cast(cast(id as string) as binary) as node", "50 as n", "cast('r' as binary) as root", "explode(array(struct(0 as at, 7L as s), struct(1 as at, 8L as s), struct(2 as at, 9L as s))) as x").select("node", "n", "root", "x.*")
    outlier = spark.sql("SELECT cast('out' AS binary) AS node, 50 AS n, cast('out' AS binary) AS root, at, s FROM VALUES (0, 7L), (1, 8L), (2, 99L) AS v(at, s)")
    met = d._met(group.unionByName(outlier))
    assert met.count() == 2 * (n + 1)
    assert met.where("roota != rootb").select("nodeb").distinct().count() == n


def test_hot_text_is_dealt_to_several_keys(spark):
    pairs = spark.range(1, 1001).selectExpr("cast('hub' as binary) as a", "cast(concat('x', id) as binary) as b")
    texts = spark.range(1, 1001).selectExpr("cast(concat('x', id) as binary) as node", "if(id % 2 = 0, repeat('a b c d e f ', 9), 'other words') as text").unionByName(spark.sql("SELECT cast('hub' AS binary) AS node, repeat('a b c d e f ', 9) AS text"))
    assert d._tested(pairs, texts).count() == 500


def test_one_of_each_and_repeats(spark):
    text = " ".join(map(str, range(100)))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " x", "b"), (3, None, "c"), (3, None, "c"), (4, "other", "d"), (None, "other", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    got = d.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["__row"]) for r in got.collect()) == [(1, "a"), (3, "c"), (3, "c"), (4, "d")]
    assert d.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 5, 10_000])
def test_components_by_contraction(spark, small):
    r = random.Random(small)
    name = lambda k: r2[k].to_bytes(4)
    r2 = r.sample(range(1 << 20), 300)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame([tuple(sorted((name(a), name(b)))) for a, b in pairs], "a binary, b binary")
    group = {k: {k} for p in pairs for k in p}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for k in group[b]:
                group[k] = group[a]
    got = {}
    for x in d.components(edges, small=small).collect():
        assert got.setdefault(bytes(x.node), bytes(x.root)) == bytes(x.root)
    assert set(got) == {name(k) for k in group}
    for k, g in group.items():
        assert got[name(k)] in {name(x) for x in g}
        assert {got[name(x)] for x in g} == {got[name(k)]}
    assert d.components(edges.limit(0), small=small).count() == 0
