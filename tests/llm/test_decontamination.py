import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    words, hit, ids = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[k : k + size]:
                    hit |= set(range(p, p + size))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def ours(text, items, window):
    words, hits, ids = d.words_of((text or "").encode()), set(), set()
    for m in d.matchers(items, window):
        for start, found in m.search(words):
            hits |= set(range(start, start + m.length))
            ids |= found
    return len(words), len(hits), sorted(ids)


TEXT = st.lists(st.sampled_from(["a", "B", "c", "É", "a.", "-", "b1"]), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=4), st.sampled_from([1, 2, 3, 5, 10]))
def test_against_brute_force(text, items, window):
    items = list(enumerate(items))
    assert ours(text, items, window) == brute(text, items, window)


def test_words_rule():
    for c in map(chr, range(0x500)):
        assert [w.decode() for w in d.words_of(f"x{c}y".encode())] == plain_words(f"x{c}y")


def test_edge_rows_and_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (3, ""), (4, "z one TWO three y"), (5, "one two")], "doc_id long, text string").selectExpr("*", "1 as Contamination", "2 as __state")
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (None, "y"), (8, None), (9, "--")], "item_id long, text string")
    for size in (d.BLOCK_WINDOWS, 1, 2):
        got = {r.doc_id: (r.contamination.n_words, bytes(r.contamination.hits or b""), r.contamination["items"]) for r in d.mark_contamination(docs, bench, window=3, block_windows=size).collect()}
        assert got == {1: (4, b"\1\1\1\0", ["7"]), 2: (0, b"", []), 3: (0, b"", []), 4: (5, b"\0\1\1\1\1", ["7"]), 5: (2, b"", [])}
    assert sorted(r.doc_id for r in d.remove_contaminated(docs, bench, window=3).collect()) == [2, 3, 3, 5]
    assert d.remove_contaminated(docs, bench).columns == docs.columns
    empty = bench.limit(0)
    assert d.remove_contaminated(docs, empty).count() == docs.count()


def test_segments_hold_each_window_once(spark):
    long = " ".join(f"W{k}" for k in range(50))
    items = spark.createDataFrame([(1, long), (2, "one Two"), (3, None), (4, "--"), (None, "É x\u00ef9. " * 4)], "item long, text string")
    for most in (1, 7, 41, 1000):
        got = {}
        for r in d.segments_of(items, 10, most).collect():
            size = min(10, len(r.words))
            assert r.windows == len(r.words) - size + 1 <= most
            got.setdefault(r.item, []).extend(" ".join(r.words[k : k + size]) for k in range(r.windows))
        w = [f"w{k}" for k in range(50)]
        assert sorted(got.pop(1)) == sorted(" ".join(w[k : k + 10]) for k in range(41))
        assert got == {2: ["one two"], None: ["É xï9 É xï9 É xï9 É xï9"]}


def test_item_with_very_many_windows(spark):
    """A benchmark item of 60,000 words, dealt into blocks, finds what one block finds."""
    words = [f"w{k % 977}x{k % 61}" for k in range(60_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words[31_000:31_030]) + " b"), (2, " ".join(words[500:509])), (3, "a Short. item")], "doc_id long, text string")
    for size in (400_000, 25_000):
        got = {r.doc_id: (bytes(r.contamination.hits or b"").count(1), r.contamination["items"]) for r in d.mark_contamination(docs, bench, block_windows=size).collect()}
        assert got == {1: (30, ["1"]), 2: (0, []), 3: (2, ["2"])}
