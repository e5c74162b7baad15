import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def rows(spark, texts, labels=(), **options):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, N_WORDS int")
    return q.judge(docs, spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int"), **options)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab|# \n\t é🙂\x1c\r", max_size=40), min_size=20, max_size=20))
def test_rules_against_brute_force(spark, texts):
    texts += [None, "", " \n ", "a b a b a b a b", "x " * 300, "the same line\n" * 9, "a\x00b c"]
    for r in rows(spark, texts).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r.kept == (not r.base_failed)  # no labels: all weights are 0


def test_model_parts_junk_from_prose(spark):
    prose = [" ".join(f"word{(k * j) % 37}" for j in range(80)) for k in range(1, 30)]
    junk = [" ".join(f"zq{(k * j) % 41}### |" for j in range(60)) for k in range(1, 15)]
    texts = prose + junk
    labels = [(k, 1, 0) for k in range(0, 29, 2)] + [(0, 1, 0), (29, 0, 0), (30, None, None)]
    kept = {r.doc_id: (r.kept, r.base_failed) for r in rows(spark, texts, labels).collect()}
    assert all(kept[k][0] or kept[k][1] for k in range(29)) and not any(kept[k][0] for k in range(29, 43))
    again = rows(spark, texts, labels).repartition(5).collect()
    assert {r.doc_id: (r.kept, r.base_failed) for r in again} == kept


def test_weights_against_brute_force(spark):
    texts, labels = ["a b a", "b c", None, "a"], [(0, 1, 0), (3, 1, 1), (1, 1, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = q.weights(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=1 << 12).first().w
    import math

    grams = lambda t: (t or "").split() + [tuple(p) for p in zip((t or "").split(), (t or "").split()[1:], strict=False)]
    raw, target = Counter(g for t in texts for g in grams(t)), Counter(g for k in (0, 1) for g in grams(texts[k]))
    m = 1 << 12
    weight = lambda g: round(1e6 * (math.log((target[g] + 1) / (target.total() + m)) - math.log((raw[g] + 1) / (raw.total() + m))))
    assert Counter(w).most_common(1)[0][0] == round(1e6 * (math.log(1 / (target.total() + m)) - math.log(1 / (raw.total() + m))))
    assert set(map(weight, raw)) <= set(w)


def test_keep_good_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60))), 5)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.keep_good(docs, labels).collect() == docs.collect()
    assert q.keep_good(docs.limit(0), labels).columns == docs.columns


def test_best_cut():
    assert q.best_cut([(-90, 0, 5), (-3, 1, 0), (2, 40, 0)]) == (-89 - 3) / 2
    assert q.best_cut([(0, 5, 0)]) is None and q.best_cut([(0, 0, 5)]) is None and q.best_cut([]) is None
    # bad ones among the good: the cut that would lose good ones is not taken
    assert q.best_cut([(-5, 0, 3), (0, 10, 0), (1, 0, 50), (2, 300, 0)]) == (-4 + 0) / 2
    assert q.best_cut([(-5, 0, 3), (0, 1, 0), (1, 0, 50), (2, 300, 0)]) == 2.0


def test_threshold_is_learnt_from_held_out_labels(spark):
    import random

    r = random.Random(6)
    prose = [" ".join(f"word{r.randrange(40)}" for _ in range(90)) for _ in range(80)]
    odd = [" ".join(f"odd{r.randrange(40)}" if r.random() < 0.4 else f"word{r.randrange(40)}" for _ in range(90)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(prose + odd)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80), 0) for k in range(160)], "doc_id long, quality int, toxic int")
    model = q.weights(docs, labels, held_out=True)
    cut = q.learnt_threshold(docs, labels, model, key="doc_id", text="text", buckets=q.BUCKETS)
    scored = {x.doc_id: (x.score / q.SCALE, x.kept, x.base_failed) for x in q.judge(docs, labels).collect()}
    held = [x.doc_id for x in docs.where(q._is_held(docs.doc_id)).collect() if not scored[x.doc_id][2]]
    low, high = max(scored[k][0] for k in held if k >= 80), min(scored[k][0] for k in held if k < 80)
    assert low < cut < high
    assert all(scored[k][1] == (scored[k][0] >= cut) for k in scored if not scored[k][2])
    right = [scored[k][1] == (k < 80) for k in scored if k not in held and not scored[k][2]]
    assert sum(right) >= 0.97 * len(right)


def test_every_label_counts(spark):
    """Labelled documents of all folds set the threshold; all trusted ones are the target; a fold's weights lack its own alone."""
    import random

    r = random.Random(8)
    text = lambda bad: " ".join(f"odd{r.randrange(40)}" if bad and r.random() < 0.4 else f"word{r.randrange(40)}" for _ in range(90))
    docs = spark.createDataFrame([(k, text(k >= 60), k) for k in range(120)], "doc_id long, text string, held_score int")
    fold = {x.doc_id: next(k for k in range(q.HELD) if x[f"f{k}"]) for x in docs.select("doc_id", *[q._is_held(docs.doc_id, k).alias(f"f{k}") for k in range(q.HELD)]).collect()}
    table = lambda keys: spark.createDataFrame([(k, int(k < 60), 0) for k in keys], "doc_id long, quality int, toxic int")
    labels = table(range(120))
    w, one = q.weights(docs, labels, held_out=True).first().w, lambda t: q.weights(docs, t).first().w
    assert w[: q.BUCKETS] == one(labels)
    for k in (0, 3):
        assert w[(k + 1) * q.BUCKETS : (k + 2) * q.BUCKETS] == one(table(d for d in fold if fold[d] != k))
    apart = table(d for d in fold if fold[d])  # none in the first fold
    model = q.weights(docs, apart, held_out=True)
    cut = q.learnt_threshold(docs, apart, model, key="doc_id", text="text", buckets=q.BUCKETS)
    assert cut != q.THRESHOLD
    whole = {x.doc_id: x for x in q.judge(docs, apart).collect()}
    assert all(x.held_score == k and (x.base_failed or x.kept == (x.score >= cut * q.SCALE)) for k, x in whole.items())
    short = q.judge(docs, apart, columns=["doc_id"]).collect()
    assert {x.doc_id: (x.score, x.kept) for x in short} == {k: (x.score, x.kept) for k, x in whole.items()}


def test_rows_carry_no_weights(spark):
    """The model is read where it is used; as a column it would be copied with each row."""
    judged = rows(spark, ["a b c"], [(0, 1, 0)])
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "__features" in plan and "scalar-subquery" in plan and "__weights" not in plan
